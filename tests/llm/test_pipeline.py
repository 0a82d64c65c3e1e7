import pytest

import corpus_pipeline as cp
from gridloom.llm.mixing import word_count

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in cp.STAGES:
        made = step(spark, docs, SF)
        path = str(tmp_path_factory.mktemp("stage") / name)
        made.write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "secrets", "mix", "tokens"]
    for name, (before, after) in stages.items():
        if name != "tokens":
            assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_decisions_take_effect(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = stages["quality"]
    kept = after.join(labels, "doc_id")
    good = before.join(labels, "doc_id").where("quality = 1").count()
    assert kept.where("quality = 0").count() < 0.05 * kept.count() and kept.where("quality = 1").count() > 0.97 * good
    before, after = stages["near_dedup"]
    assert after.select("text").distinct().count() == after.count() < before.count()
    before, after = stages["secrets"]
    assert after.count() == before.count() and after.where("text rlike 'AKIA[A-Z0-9]{12}'").count() == 0 and after.where("text like '%<SECRET>%'").count() > 0
    before, after = stages["mix"]
    words = lambda d: d.select(word_count("text").alias("n")).agg({"n": "sum"}).first()[0]
    assert abs(words(after) / words(before) - 1.5) < 0.1
    assert stages["tokens"][1].count() == after.count()


def test_run_equals_the_stages(spark, stages):
    got = sorted(tuple(r) for r in cp.run(spark, SF).collect())
    assert got == sorted(tuple(r) for r in stages["tokens"][1].collect())


def test_odd_rows_pass_through(spark):
    rows = [(1, None, "en", "a", None), (1, None, "en", "a", None), (2, "", None, None, 0), (None, "some words here", "en", "a", 15), (3, "same", "en", "b", 4), (3, "same", "en", "b", 4)]
    extra = ("_score", "_key", "_copies", "_id", "score", "c0")
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in extra:
        frame = frame.withColumn(c, frame["lang"])
    for name, step in cp.STAGES:
        for docs in (frame, frame.limit(0)):
            out = step(spark, docs, SF)
            got = out.count()
            assert (got == 0) == (docs is not frame) or name in ("quality", "mix")
            if name != "tokens":
                assert out.columns == frame.columns


def test_run_against_brute_force(spark, tmp_path):
    """All stages by plain loops: scores row by row, all pairs, patterns and owners, the library's tokens."""
    import hashlib
    import re

    import numpy as np
    from pyspark.sql import functions as F
    from test_text_operators import WORD, brute_classes, brute_secrets
    from tokenizers import Tokenizer

    from gridloom.llm import gam_quality as gam
    from gridloom.llm import mixing as mix
    from gridloom.llm import secret_scan as sec
    from gridloom.llm.queries import word_vocabulary

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = " ".join(f"Well written sentence number {i} follows here, as it should." for i in range(20))
    other = " ".join(f"Another good line, the {i}th of its kind, tells something else here." for i in range(20))
    token = "aB3dE5gH7jK9mN1pQ3sT5vW7x"
    more = [(9001, f"{good} key {token} end", "en", "only", 1), (9002, f"{other} password=hunter2hunter2 done", "en", "only", 1), (9003, None, "en", "only", None), (9004, "", "en", "none", 0)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = gam.quality_model(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rows = [r for r in docs.orderBy("doc_id").collect() if model.score(np.array([gam.features(r["text"] and r["text"].encode())]))[0] >= cp.KEEP_FROM]
    assert 0 < len(rows) < docs.count()
    classes = brute_classes([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for i, r in enumerate(rows) if classes.index(classes[i]) == i]
    assert {9001, 9002} <= {r["doc_id"] for r in rows}
    # secrets: base patterns, and random-looking tokens beside them that one owner alone holds
    found, held = {}, {}
    for r in rows:
        text = r["text"] or ""
        base = brute_secrets(text)
        bare = [(m.start(), 3, m.end()) for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])", text) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and sec.entropy(m[0].encode()) >= 3.5]
        found[r["doc_id"]] = base, [s for s in bare if not any(a < s[2] and s[0] < b for a, _, b in base)]
        for a, _, b in found[r["doc_id"]][1]:
            held.setdefault(text[a:b], set()).add((r["source"], r["lang"]))
    clean = []
    for r in rows:
        text, out, at = r["text"], "", 0
        base, bare = found[r["doc_id"]]
        live = [s for s in bare if len({o for o, _ in held[text[s[0] : s[2]]]}) == 1 and len(held[text[s[0] : s[2]]]) < 6]
        for a, _, b in sorted(base + live):
            out, at = (out + text[at:a] + "<SECRET>" if a >= at else out), max(at, b)
        clean.append((r["doc_id"], text if text is None else out + text[at:], r["source"]))
    assert any(t and "<SECRET>" in t for _, t, _ in clean)
    # the mix's copies come from the words it takes, which are held against loops elsewhere
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mix.mix_sources(spark.createDataFrame(clean, "doc_id long, text string, source string")).collect()}
    library, want = Tokenizer.from_file(word_vocabulary()), []
    for i, text, _ in clean:
        assert taken[i][1] == len(WORD.findall(text or ""))
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        row = (i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
        want += [row] * (int(taken[i][0] / taken[i][1] + 0.5) if taken[i][1] else 0)
    got = cp.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and got.where(F.col("doc_id") == 9001).count() > 0


def test_very_long_texts_pass_through(spark):
    """A text of 400,000 words goes through every stage whole."""
    long = " ".join(f"word{i % 9973} is number {i}, and it ends." if i % 7 else f"Line {i}.\n" for i in range(60_000))
    rows = [(1, long, "en", "a", len(long)), (2, long + " One more.", "en", "a", len(long) + 10), (3, "Some short text of its own, well written and sound.", "en", "b", 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert cp.near_dedup(spark, docs, SF).count() == 2 and cp.quality(spark, docs, SF).columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cp.secrets(spark, docs, SF).collect()} == {i: t for i, t, *_ in rows}
    assert cp.mix(spark, docs, SF).columns == docs.columns
    assert {r["doc_id"]: r["n_tokens"] > 300_000 for r in cp.tokens(spark, docs, SF).collect()} == {1: True, 2: True, 3: False}
