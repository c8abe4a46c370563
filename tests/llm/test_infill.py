"""Fill-in-the-middle forms against a plain version."""

import hashlib

import pyarrow as pa

from sparklog.llm import infill

TEXTS = [
    (1, "hello world, this is a text"), (2, ""), (3, None), (4, "a"), (5, "ünïcödé 漢字 😀 text " * 9), (6, "it holds <S> inside"), (7, "<P><M>"), (8, "half <S and <P"), (9, "\r\n\t  "),
    (None, "no id"), (10, "twice"), (10, "twice"), (10, "other text of one id"), *[(k, f"text {k} 😀" * (k % 7 + 1)) for k in range(20, 120)],
]


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def forms(df):
    rows = infill.infill_documents(df).select("doc_id", "text", "infill.*").collect()
    return rows, sorted(map(repr, ((r["doc_id"], r["text"], *r[2:]) for r in rows)))


def test_forms_equal_a_plain_version(spark, monkeypatch):
    df = spark.createDataFrame([(*t, "kept", 1) for t in TEXTS], "doc_id long, text string, infill string, prefix int")
    rows, found = forms(df)
    assert found == sorted(repr((i, t, *plain(i, t))) for i, t in TEXTS)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    again = infill.infill_documents(df)
    assert "infill_input" in again.columns and again.filter("infill_input = 'kept' AND prefix = 1").count() == len(TEXTS)
    x = again["infill"]
    assert again.filter(~infill.restored(x["output"], x["form"]).eqNullSafe(infill.F.coalesce("text", infill.F.lit("")))).count() == 0


def test_pieces_of_long_texts_are_joined_again(monkeypatch):
    monkeypatch.setattr(infill, "STEP", 7)
    texts = ["", "short", "漢字かな交じり文" * 9, "x" * 50, "😀" * 20, "", "end"]
    for first, second in ((0, 0), (3, 5), (10, 44), (1000, 1000)):
        n = len(texts)
        roles = infill.split_roles(pa.array(texts), pa.array([first] * n, pa.int64()), pa.array([second] * n, pa.int64()))
        assert [r.to_pylist() for r in roles] == [[t[:first] for t in texts], [t[first:second] for t in texts], [t[second:] for t in texts]]


def test_sliced_batches(spark):
    texts = pa.array(["skip", "äb", "漢字"]).slice(1)
    roles = infill.split_roles(texts, pa.array([1, 1], pa.int64()), pa.array([1, 2], pa.int64()))
    assert [r.to_pylist() for r in roles] == [["ä", "漢"], ["", "字"], ["b", ""]]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert infill.infill_documents(df).collect() == []
