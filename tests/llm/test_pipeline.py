"""The corpus pipeline, stage by stage, against brute force on a small table."""

import corpus_pipeline
from tallyloom.llm.base import save

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = save(stage(spark, docs, SF))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "language":
            assert len(after) >= 0.99 * len(before)
        if name == "near_duplicates":
            sets = {k: shingles(r.text) for k, r in before.items()}
            top = {k: k for k in sets}
            for a in sorted(sets):
                for b in sorted(sets):
                    both = len(sets[a] & sets[b]) if a < b else 0
                    if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        low, high = sorted((top[a], top[b]))
                        top = {k: low if v == high else v for k, v in top.items()}
            assert set(after) == {k for k, v in top.items() if k == v}
        if name == "decontamination":
            items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {k for k, r in before.items() if not any(100 * len(shingles(r.text) & i) >= 80 * len(i) for i in items)}
        if name == "secret_scan":
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in after.values())
        if name == "token_ids":
            assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"] and all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in after.values())
        else:
            assert docs.columns == columns
    whole = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {k: bytes(r.ids) for k, r in after.items()}


def test_stages_keep_odd_rows_and_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, redacted string"
    rows = [(1, None, None, None, None, None, None, None), (None, "the words of a text without any id", "en", None, None, None, "q", None), (3, 'the password = "Zx81kLmQ09aa" is here', "en", "s", 5, 0.5, "p", "r"), (4, "", "en", "s", 0, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, SF))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
    left = {r.doc_id: r for r in docs.collect()}
    assert set(left) == {None, 3}
    assert left[3].text == 'the [REDACTED]" is here' and left[3].n_chars == len(left[3].text) and (left[3].lang_pred, left[3].redacted) == ("p", "r")


def test_language_keeps_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    strange = ["日", "日本語の文章はここにある", "Ελληνικά κείμενα εδώ", "текст на русском", "xqzj kwvx qqzz"]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    after = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(more, allowMissingColumns=True), SF).select("doc_id").collect()}
    before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    short = {k for k, t in before.items() if t and len(t.split()) <= 4 and any(c.isalpha() for c in t)}
    assert len(short) > 50 and short <= after
    assert {k for k, t in before.items() if t and any(c.isalpha() for c in t)} <= after
    assert not after & {-1 - i for i in range(len(strange))}


def test_one_row_of_each_near_duplicate_group(spark):
    same, other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(5, same), (5, same), (None, other), (None, other), (None, third), (7, third), (3, same + " x"), (9, "a text that shares its id"), (9, other + " y"), (2, other + " z"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    assert left == sorted([(3, same + " x"), (2, other + " z"), (7, third), (9, "a text that shares its id"), (None, None), (None, None)], key=str)
