"""Secret scans: base patterns, high-entropy candidates, and how widely each candidate's value is owned across the corpus.

For each value the distinct owners that hold it are counted, and the distinct repositories (an owner's documents under one
repository name; in ``documents`` the owner is the source, and its repositories are told apart by language, since the table names
none). A value in many owners' hands, or in many repositories, is a widely copied example; one that a single owner (or few) holds
in few repositories is owner-specific and, as it looks random, a live-looking credential. Base spans are always reported; the
method adds spans of kind ``owned``: random-looking tokens beyond the base patterns whose value is live-looking. Values are
compared by a 128-bit hash, never shown.

Defined results. Null text: as empty, no spans. Null owner or repository: one of its own. Repeated rows: each is returned with
its spans, and counts once for its owner. No repository column: every owner has one repository. Empty table: empty result. Spans
are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import map_arrow, shielded, sized_join, stage, text_key, text_slices, unshielded

# fixed values: the base patterns, over UTF-8 bytes (all classes are ASCII, so bytes and characters match alike)
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")
# a token that may be a bare credential
TOKEN = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
KINDS = ("assign", "access", "hex", "owned")


def entropy(value: bytes) -> float:
    """Bits a byte."""
    return -sum(k / len(value) * math.log2(k / len(value)) for k in Counter(value).values())


def base_spans(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, end, kind, value) in bytes of the base patterns, by start, then kind as listed."""
    found = [(m.start(), m.end(), 0, m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def bare_tokens(text: bytes, base: list[tuple[int, int, int, bytes]], min_entropy: float = 3.5) -> list[tuple[int, int, int, bytes]]:
    """Random-looking tokens outside the base spans (sorted by start): digits, both letter cases, and enough entropy.

    Tokens and base spans are met in one pass: spans that start before the token's end are taken in, and what they reach is kept.
    """
    found, i, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][1])
            i += 1
        v = m[0]
        if reach <= m.start() and re.search(rb"[0-9]", v) and re.search(rb"[a-z]", v) and re.search(rb"[A-Z]", v) and entropy(v) >= min_entropy:
            found.append((m.start(), m.end(), 3, v))
    return found


def _points(text: bytes, spans: list[tuple[int, int, int, bytes]]) -> list[dict]:
    """The spans in code points, with the hash of each value."""
    out, at, points = [], 0, {}
    for place in sorted({x for s in spans for x in s[:2]}):
        points[place] = points[at] + len(text[at:place].decode("utf-8", "replace")) if at in points else len(text[:place].decode("utf-8", "replace"))
        at = place
    for a, b, kind, value in spans:
        out.append({"kind": kind, "start": points[a], "end": points[b], "value": hashlib.blake2b(value, digest_size=16).digest()})
    return out


def scan(text: bytes | None) -> list[dict]:
    """All candidate spans of one text, by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    return _points(text, sorted(base + bare_tokens(text, base), key=lambda x: (x[0], x[2])))


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary())]))
_SPANS_DDL = "array<struct<kind:int,start:bigint,end:bigint,value:binary>>"


def _scanned(batches):
    for rows, texts in text_slices(batches, "_text"):
        yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(map(scan, texts.to_pylist()), _SPANS)], ["_id", "_owner", "_repo", "_found"])


def _held_by(docs: DataFrame, owner_col: str, repo_col: str) -> list[Column]:
    """Owner and repository of each row as strings; a column that isn't there is null."""
    return [(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast("string").alias(n) for c, n in ((owner_col, "_owner"), (repo_col, "_repo"))]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang") -> DataFrame:
    """One staged row a document: a row number ``_row`` (fixed once written), ``_id``, ``_owner``, ``_repo`` and its candidate spans."""
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), *_held_by(docs, owner_col, repo_col), F.col(text_col).alias("_text"))
    return stage(map_arrow(narrow, _scanned, f"_id long, _owner string, _repo string, _found {_SPANS_DDL}").withColumn("_row", F.monotonically_increasing_id()), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners, distinct repositories (owner and name), and documents of each candidate value; sums are partial first."""
    each = found.select("_owner", "_repo", F.explode(F.array_distinct("_found.value")).alias("value"))
    by_repo = each.groupBy("value", "_owner", "_repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("value", "_owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repositories"), F.sum("n").alias("documents"))


def judged_spans(found: DataFrame, max_owners: int = 1, example_owners: int = 3, example_repositories: int = 6) -> DataFrame:
    """Spans by document after the corpus-wide verdict: ``spans`` (kept ones) with ``live`` and ``example`` flags.

    Documents without candidates skip the join. A value that a third of the documents hold is one row of the frequency
    table; its partition on the other side is split by adaptive execution.
    """
    each = found.where(F.size("_found") > 0).select("_row", F.explode("_found").alias("s")).select("_row", "s.*")
    known = each.join(stage(ownership(found), "owners"), "value")  # staged, so that both sides are dealt anew
    example = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    live = (F.col("owners") <= max_owners) & ~example
    span = F.struct("start", "kind", "end", live.alias("live"), example.alias("example"))
    return known.where((F.col("kind") < 3) | live).groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", max_owners: int = 1, example_owners: int = 3, example_repositories: int = 6) -> DataFrame:
    """``doc_id`` and ``spans``, an array of (start, kind, end, live, example) by start, then kind; kinds index KINDS."""
    found = candidates(docs, id_col, text_col, owner_col, repo_col)
    spans = judged_spans(found, max_owners, example_owners, example_repositories)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean,example:boolean>>")
    return found.select("_row", F.col("_id").alias("doc_id")).join(spans, "_row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from ``secret_scan``'s."""
    kinds = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda keep: F.size(F.filter("spans", keep)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k)
    return scanned.select(
        "doc_id", *(of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: s["example"]).alias("n_example"),
    )


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """``documents`` with every reported span replaced by ``mark`` and ``n_chars``, if there, set anew; all rows and columns stay.

    The verdict of a span depends on the text and the corpus alone, so spans are joined by the text's 128-bit key: documents
    with spans are few beside the corpus, and the join broadcasts them only if their counted rows are few.
    """
    keyed = docs.select(text_key("text").alias("_id"), *_held_by(docs, "source", "lang"), F.col("text").alias("_text"))
    found = stage(map_arrow(keyed, _scanned, f"_id binary, _owner string, _repo string, _found {_SPANS_DDL}").where(F.size("_found") > 0).withColumn("_row", F.monotonically_increasing_id()), "secrets")
    spans = judged_spans(found).join(found.select("_row", "_id"), "_row").groupBy("_id").agg(F.first("spans").alias("_spans"))
    narrow = stage(spans.withColumnRenamed("_id", "_key"), "redact")
    flat, names = shielded(docs)
    body = F.col(names["text"])
    joined = sized_join(flat.withColumn("_key", text_key(body)), narrow, ["_key"], "left")
    # overlapping spans are merged from the left: what lies before the reach of the earlier ones is not kept again
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    end = lambda acc: F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body)))
    clean = joined.withColumn("_text", F.when(F.col("_spans").isNull(), body).otherwise(F.aggregate("_spans", start, step, end)))
    if "n_chars" in names:
        chars = F.col(names["n_chars"])
        clean = clean.withColumn(names["n_chars"], F.when(F.col("_spans").isNull(), chars).otherwise(F.length("_text").cast("long")))
    return unshielded(clean.withColumn(names["text"], F.col("_text")), names)
