"""Near duplicates by ProbMinHash: weighted word shingles, Poisson arrivals with early termination, banding, verification.

The elements of a text are its runs of five words, weighted by how often they occur (a text of one to four words is one
element). Each element is the source of a Poisson process whose rate is its weight; an arrival has a time and a slot, both from
a hash of the element and the arrival's number. A slot keeps the element that arrives first; two texts agree in a slot with
the probability of their probability Jaccard. An element stops as soon as its next arrival is later than the latest slot, so
a text of n elements costs about n + m log m arrivals for m slots. All elements of a slice advance together, arrival by
arrival, which gives the same signature as one by one.

Candidates share one of ``bands`` runs of ``rows`` slots. A link is a candidate pair whose exact probability Jaccard, with
counts as weights or with equal weights (then it is the plain Jaccard index), is ``threshold`` or more; a text with repeated
elements has a second signature with equal weights, so that neither measure loses candidates. Classes are the connected
components of the links.

Copies are collapsed first: the nodes of all later steps are distinct texts. In a bucket the pairs are not enumerated: its
members are compared with one pivot, the member that shares most buckets with others, and classes are formed. Buckets that
then still hold several classes go through an exact prefix filter: with a text's elements ordered from the corpus' rarest
on, two texts that reach the threshold share one of those elements behind which (itself included) at least ``threshold`` of
the weight lies. Texts of different classes that share such an element meet, those outside an element's largest class with all; the join's
condition holds two exact bounds against each meeting: the elements from that one on must be enough for the overlap, and the
distance of two parity bitmaps, which is at most the size of the symmetric difference, must not be too large. What passes is
verified. So no link between classes is lost, while n near copies cost about n pairs rather than n squared.

Defined results. Null text: never a duplicate, a class of its own. Texts without words: a duplicate of the same text only.
Null doc_id: takes part; it never names a class that has another id. Repeated rows: one class; each row is returned. Empty
table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import hashed_words, map_arrow, mix64, shielded, sized_join, stage, text_key, text_slices, unshielded, unstage

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 18, 4
_U = np.uint64


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each text of a slice: text number, 64-bit hash, count; ordered by text and hash."""
    word, of = hashed_words(texts)
    if not len(word):
        return np.empty(0, np.int64), np.empty(0, _U), np.empty(0, np.int64)
    size = np.bincount(of, minlength=len(texts))
    width = np.minimum(size, words)  # a short text is one element of all its words
    begin = np.cumsum(size) - size
    n = np.maximum(size - words + 1, (size > 0).astype(np.int64))
    text = np.repeat(np.arange(len(texts)), n)
    start = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    value = np.full(len(start), 0x51ED270B, _U) + width[text].astype(_U)
    for j in range(words):
        inside = width[text] > j
        value = np.where(inside, mix64(value * _U(0x9E3779B97F4A7C15) + word[np.minimum(start + j, len(word) - 1)]), value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (value[1:] != value[:-1])])
    return text[new], value[new], np.diff(np.r_[new, len(text)])


def signatures(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n_texts: int, slots: int) -> np.ndarray:
    """The element that arrives first in each slot of each text; a row of zeros for a text without elements."""
    first = np.full(n_texts * slots, np.inf)
    who = np.zeros(n_texts * slots, _U)
    time = np.zeros(len(value))
    rate = weight.astype(float)
    arrival = 0
    while len(value):
        arrival += 1
        draw = mix64(value + _U(arrival * 0xA0761D6478BD642F % 2**64))
        time = time - np.log(((draw >> _U(11)).astype(float) + 0.5) * 2.0**-53) / rate
        slot = text * slots + ((mix64(draw ^ _U(0xE7037ED1A0B428DB)) >> _U(32)) * _U(slots) >> _U(32)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = time == first[slot]
        who[slot[won]] = value[won]
        go = time < first.reshape(n_texts, slots).max(1)[text]
        text, value, rate, time = text[go], value[go], rate[go], time[go]
    return who.reshape(n_texts, slots)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value for each band; the band's number is part of it."""
    part = signature.reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=_U) * _U(0x2545F4914F6CDD1D), part.shape[:2])
    for j in range(rows):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + part[:, :, j])
    return out


def _signed(bands: int, rows: int):
    def run(batches):
        for got, texts in text_slices(batches, "_text"):
            text, value, count = shingles(texts)
            weighted = band_hashes(signatures(text, value, count, len(texts), bands * rows), bands, rows).view(np.int64)
            has = np.bincount(text, minlength=len(texts)) > 0
            repeats = np.bincount(text, count > 1, minlength=len(texts)) > 0
            lists = [weighted[i].tolist() if ok else [] for i, ok in enumerate(has)]
            if repeats.any():  # the same with equal weights
                number = np.cumsum(repeats) - 1
                mine = repeats[text]
                plain = band_hashes(signatures(number[text[mine]], value[mine], np.ones(mine.sum()), int(repeats.sum()), bands * rows), bands, rows).view(np.int64)
                for i in np.flatnonzero(repeats):
                    lists[i] = list(dict.fromkeys([*lists[i], *plain[number[i]].tolist()]))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array(lists, pa.list_(pa.int64()))], ["_id", "_key", "_bands"])

    return run


#: Longs of the parity bitmap that stands for a set in join conditions.
BITMAP = 16


def parity(value: np.ndarray) -> np.ndarray:
    """A bitmap in which each element flips one bit: two bitmaps differ in at most as many bits as the sets in elements."""
    flips = np.bincount((mix64(value) >> _U(54)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _element_sets(batches):
    for got, texts in text_slices(batches, "_text"):
        text, value, count = shingles(texts)
        at = np.searchsorted(text, np.arange(len(texts) + 1))
        rows = [(value[a:b].tobytes(), count[a:b].astype(np.uint32).tobytes(), parity(value[a:b]).tolist(), b - a, bool((count[a:b] == 1).all())) for a, b in zip(at, at[1:], strict=False)]
        kinds = (pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([got.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["_key", "_set", "_count", "_bits", "size", "even"])


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The larger of the plain Jaccard index and the probability Jaccard of two sorted sets with weights.

    The latter is the sum over common elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i). With the common
    elements ordered by x / y, the inner sum is a prefix sum of x over x_i plus a suffix sum of y over y_i.
    """
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    plain = len(ia) / (len(a) + len(b) - len(ia))
    if len(ia) == len(a) == len(b) and np.array_equal(wa, wb) or wa.max() == wb.max() == 1:
        return plain
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # max(x_j / x_i, y_j / y_i) is the former where x_j / y_j >= x_i / y_i; of an element of one text only, its own
    after_x = np.cumsum(x[::-1])[::-1] + (wa.sum() - x.sum())
    before_y = np.cumsum(y) - y + (wb.sum() - y.sum())
    return max(plain, float((1 / (after_x / x + before_y / y)).sum()))


def _verified(threshold: float):
    def run(batches):
        known: tuple[bytes, np.ndarray, np.ndarray] = (b"", np.empty(0), np.empty(0))
        for batch in batches:
            keep = []
            for a, sa, ca, sb, cb in zip(*(batch.column(n).to_pylist() for n in ("a", "_sa", "_ca", "_sb", "_cb")), strict=True):
                if known[0] != a:
                    known = a, np.frombuffer(sa, _U), np.frombuffer(ca, np.uint32)
                keep.append(similarity(known[1], known[2], np.frombuffer(sb, _U), np.frombuffer(cb, np.uint32)) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return run


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of pairs (a, b): ``node`` and its smallest connected node ``root``.

    Each round gives every node the smallest label around it, then the label of its label (which halves the longest way to
    go). All rounds are joins and partial aggregations over staged tables; a hub's partition is split by adaptive execution.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    for _ in range(max_rounds):
        named = label.select("node", "root")
        near = both.join(named, both["b"] == named["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        # the roots learn too: a label that a neighbour's class has is handed to the root itself
        step = named.join(near, "node").select("node", "root", F.least("root", "m").alias("m"))
        hooks = step.where(F.col("m") < F.col("root")).groupBy(F.col("root").alias("node")).agg(F.min("m").alias("hook"))
        step = stage(step.join(hooks, "node", "left").select("node", "root", F.least("m", F.coalesce("hook", "m")).alias("m")), "hooked")
        up = step.select(F.col("node").alias("m"), F.col("m").alias("up"))
        new = stage(step.join(up, "m", "left").select("node", F.least("m", F.coalesce("up", "m")).alias("root"), F.col("root").alias("old")), "labels")
        unstage(label, step)
        label = new
        if label.where(F.col("root") != F.col("old")).isEmpty():
            unstage(both)
            return label
    raise RuntimeError("components didn't settle")


def _tokens(batches):
    for batch in batches:
        for n, raw, count in zip(*(batch.column(c).to_pylist() for c in ("n", "_set", "_count")), strict=True):
            value = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(np.full(len(value), n)), pa.array(np.frombuffer(count, np.uint32).astype(np.int64))], ["token", "n", "w"])


def prefixes(sets: DataFrame, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """(token, n, after) of the elements by which a text must meet another one; elements of one text only are left out.
    Beside it the staged tables that it reads.

    ``after`` is the number of the text's elements from that one on.

    The suffix from an element on, in the order (texts that have it, element), must hold the threshold's share of the
    text's elements or of its weight; for a pair that reaches the threshold by either measure, its first common element
    is then in the prefix of both.
    """
    each = stage(map_arrow(sets.select("n", "_set", "_count"), _tokens, "token long, n long, w long"), "tokens")
    often = stage(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1), "often")
    lists = each.join(often.hint("merge"), "token").groupBy("n").agg(F.sort_array(F.collect_list(F.struct("df", "token", "w"))).alias("known"))
    size = each.groupBy("n").agg(F.count(F.lit(1)).alias("size"), F.sum("w").alias("mass"))

    def run(batches):
        for batch in batches:
            for n, known, size, mass in zip(*(batch.column(c) for c in ("n", "known", "size", "mass")), strict=True):
                flat = known.values
                w = flat.field("w").to_numpy()
                after = np.cumsum(w[::-1])[::-1]
                count = np.arange(len(w), 0, -1)
                ok = (count >= threshold * size.as_py() - 1e-9) | (after >= threshold * mass.as_py() - 1e-9)
                token = flat.field("token").to_numpy()[ok]
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.full(len(token), n.as_py())), pa.array(count[ok])], ["token", "n", "after"])

    return map_arrow(lists.join(size, "n"), run, "token long, n long, after long"), [each, often]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: ``doc_id``, ``class_id`` (the class's smallest doc_id), ``class_texts`` (distinct texts), ``kept``.

    ``kept`` is true for the rows of the text that stands for the class. ``_key`` is the text's 128-bit key. Texts are read
    by one Python pass for signatures; the verification reads the texts of candidates only.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("_id"), text_key(text_col).alias("_key"), F.col(text_col).alias("_text"))
    signed = stage(map_arrow(keyed, _signed(bands, rows), "_id long, _key binary, _bands array<long>"), "signatures")
    # copies collapse: a node is a distinct text, with its smallest id
    nodes = stage(signed.where(F.col("_key").isNotNull()).groupBy(F.col("_key").alias("node")).agg(F.min("_id").alias("id"), F.first("_bands").alias("bands")), "nodes")
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    # tables that are joined back to what they sum up are staged and merged: then both sides are dealt anew at every size, and
    # adaptive execution splits the rows of a hot key
    crowded = stage(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "crowded")
    member = stage(member.join(crowded.hint("merge"), "bucket"), "buckets")
    unstage(crowded)

    # the elements of the texts that stand in a crowded bucket: the others can't be linked
    wanted = stage(member.groupBy(F.col("node").alias("_key")).agg(F.sum("n").alias("degree")), "wanted")
    texts = sized_join(keyed.where(F.col("_key").isNotNull()).select("_key", "_text"), wanted.select("_key"), ["_key"], "left_semi")
    one = texts.groupBy("_key").agg(F.first("_text").alias("_text"))
    sets = stage(map_arrow(one, _element_sets, "_key binary, _set binary, _count binary, _bits array<long>, size long, even boolean").withColumn("n", F.monotonically_increasing_id()), "elements")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("_key").alias("a"), F.col("_set").alias("_sa"), F.col("_count").alias("_ca"))
        right = sets.select(F.col("_key").alias("b"), F.col("_set").alias("_sb"), F.col("_count").alias("_cb"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "_sa", "_ca", "_sb", "_cb")
        return stage(map_arrow(both, _verified(threshold), "a binary, b binary, linked boolean").where("linked"), "links")

    central = member.join(wanted.withColumnRenamed("_key", "node"), "node")
    pivot = stage(central.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("p")).select("bucket", F.col("p.node").alias("pivot")), "pivots")
    star = member.join(pivot.hint("merge"), "bucket").where(F.col("node") != F.col("pivot")).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = verified(star)
    unstage(pivot, wanted)
    named = components(links)
    rooted = stage(member.select("node", "bucket").join(named.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    unstage(member)
    several = stage(rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where(F.col("x") != F.col("y")).select("bucket"), "several")
    open_texts = stage(rooted.join(several.hint("merge"), "bucket").select("node", "root").distinct(), "open")
    unstage(rooted, several)
    if not open_texts.isEmpty():
        mine = stage(sets.join(open_texts.select(F.col("node").alias("_key"), "root"), "_key"), "open-elements")
        bits = [F.get("_bits", F.lit(i)).alias(f"b{i}") for i in range(BITMAP)]
        prefix, read = prefixes(mine, threshold)
        meet = stage(prefix.join(mine.select("n", F.col("_key").alias("node"), "root", "size", "even", *bits), "n").drop("n"), "meet")
        unstage(mine, *read)
        largest = meet.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "root")).alias("m"), F.count(F.lit(1)).alias("classes")).where(F.col("classes") > 1)
        largest = stage(largest.select("token", F.col("m.root").alias("main")), "largest")
        stray = meet.join(largest.hint("merge"), "token").where(F.col("root") != F.col("main")).drop("main")
        stray = stage(stray.select("token", *(F.col(c).alias(f"s_{c}") for c in stray.columns if c != "token")), "strays")
        other = stray.hint("merge")
        both = F.col("size") + F.col("s_size")
        apart = sum((F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"s_b{i}"))) for i in range(BITMAP)), F.lit(0))
        plain = (F.least("after", "s_after") >= threshold / (1 + threshold) * both - 1e-9) & (apart <= (1 - threshold) / (1 + threshold) * both + 1e-9)
        far = meet.join(other, (meet["token"] == other["token"]) & (F.col("root") != F.col("s_root")) & (F.col("node") != F.col("s_node")) & (plain | ~(F.col("even") & F.col("s_even"))))
        more = verified(far.select(F.least("node", "s_node").alias("a"), F.greatest("node", "s_node").alias("b")).distinct())
        unstage(meet, largest, stray, named)
        named = components(links.union(more))
        unstage(more)
    unstage(sets, links, open_texts)
    classed = stage(nodes.select("node", "id").join(named.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "classed")
    unstage(named, nodes)
    # the text of the smallest id stands for the class; a class without any id is stood for by its smallest key
    best = stage(classed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "node")).alias("best"), F.count(F.lit(1)).alias("class_texts")), "best")
    per_text = classed.join(best, "root").select(F.col("node").alias("_key"), F.col("best.id").alias("class_id"), (F.col("best.node") == F.col("node")).alias("stands"), "class_texts")
    result = signed.select("_id", "_key").join(per_text, "_key", "left")
    alone = F.col("_key").isNull()
    judged = result.select(
        F.col("_id").alias("doc_id"), F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_texts", F.lit(1)).cast("long").alias("class_texts"),
        (alone | (F.col("stands") & F.col("_id").eqNullSafe(F.col("class_id")))).alias("kept"), "_key",
    )
    judged = stage(judged, "judged")
    unstage(signed, classed, best)
    return judged


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """``documents`` (columns ``doc_id`` and ``text`` at least) with one row of each class, columns as they came; rows with a null
    text all stay.

    The rows to drop are a narrow table (id and key), joined by broadcast if their counted rows are few. Rows that repeat
    both id and text would all stay; they are counted, and only if there are any are the kept rows made distinct by key.
    """
    judged = near_duplicates(docs, **settings)
    gone = stage(judged.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), "_key").distinct(), "gone")
    flat, names = shielded(docs)
    keyed = flat.withColumn("_key", text_key(names["text"]))
    rows = sized_join(keyed, gone, keyed["_key"].eqNullSafe(gone["_key"]) & F.col(names["doc_id"]).cast("long").eqNullSafe(gone["_gone"]), "left_anti")
    kept = judged.where(F.col("kept") & F.col("_key").isNotNull())
    counts = kept.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_key").alias("k")).first()
    unstage(judged)
    if counts["n"] > counts["k"]:
        rows = rows.where(F.col("_key").isNotNull()).dropDuplicates(["_key"]).union(rows.where(F.col("_key").isNull()))
    return unshielded(rows, names)
