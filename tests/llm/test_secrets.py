"""op9: accuracy on findings it has not seen, and odd rows."""

from collections import Counter

import numpy as np

from skarn.llm import secrets as s


def test_held_out_findings():
    train, test = s.labelled_findings(2000, seed=1), s.labelled_findings(600, seed=2)
    language = s.Language([b for b, _, _, _ in train])
    y = lambda rows: np.array([r[3] for r in rows], float)
    x = lambda rows: np.array([s.features(b, c, a, language) for b, c, a, _ in rows])
    forest = s.Forest(x(train), y(train))
    assert ((forest.score(x(test)) >= s.CUT) == y(test)).mean() >= 0.95


def test_rows(spark):
    text = 'Ünï token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff of docs/reading/main2/index.html'
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "a1" * 40_000), (None, "nothing here")]
    df = spark.createDataFrame([(b, a, 5) for a, b in rows], "text string, doc_id long, n_secrets int")
    got = s.find_secrets(df).collect()
    assert len(got) == 6
    one = [r for r in got if r.doc_id == 1]
    at = text.index("24be")
    assert len(one) == 2 and all(r.n_candidates == 3 and r.n_secrets == 1 and r.spans.startswith(f"{at}:{at + 40}:") for r in one)
    assert all(r.n_secrets == 0 and r.spans == "" for r in got if r.doc_id in (2, 3, None))
    assert s.find_secrets(df.limit(0)).collect() == []


def test_whole_runs_and_short_values(spark):
    rnd = s.random.Random(4)
    long_, short, plain = rnd.randbytes(480).hex(), "x7Kq9Zp2Lm", "AKIA" + "QWERTZUIOPASDFGH"
    rows = [(1, f'token = "{long_}" end'), (2, f'password = "{short}"'), (3, f"key: {plain} "), (4, "a-very-long-run-of-plain-words/and/paths"), (5, "a" * 200_000 + "1")]
    got = {r.doc_id: (r.n_candidates, [tuple(map(int, x.split(":")[:2])) for x in r.spans.split(",") if x]) for r in s.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, secret in ((1, long_), (2, short), (3, plain)):
        at = dict(rows)[i].index(secret)
        assert got[i] == (1, [(at, at + len(secret))])
    assert got[4] == (0, []) and got[5][0] == 1


def test_planted_secrets_of_the_corpus(spark):
    """Tokens that the test tables plant; none of them is a training row."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pattern = s.re.compile(r'token = "([0-9a-f]{40})"')
    planted = {(r.doc_id, m.start(1), m.end(1)) for r in docs.select("doc_id", "text").collect() for m in pattern.finditer(r.text or "")}
    got = {(r.doc_id, *map(int, x.split(":")[:2])) for r in s.find_secrets(docs).collect() for x in r.spans.split(",") if x}
    assert len(planted) >= 5 and len(planted & got) >= 0.9 * len(planted)


def test_language_covers_all_documents(spark, monkeypatch):
    """Every row counts, also behind the 500th and over 32 KiB, and whenever a task emits its words."""
    rows = [(i, f"common words here {'zyxwv' if i > 700 else ''}") for i in range(800)] + [(9000, "qqxqq filler " * 4000), (9001, None), (None, "vvjvv vvjvv"), (5, "common")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter(w for _, t in rows for w in s.re.findall(r"[a-z]{2,20}", t or ""))
    for held in (s.HELD, 2):
        monkeypatch.setattr(s, "HELD", held)
        got = s.word_counts(df).collect()
        assert {r.word: r.n for r in got if r.word} == {w: n for w, n in want.items() if len(w) > 2}
        assert {(r.a, r.b): r.n for r in got if r.word is None} == {(a, b): n for (a, b), n in np.ndenumerate(s.transitions(want)) if n}
    language = s.corpus_language(df, ["some context"])
    assert {"zyxwv", "qqxqq", "vvjvv"} <= language.words and "some" not in language.words
    assert np.allclose(language.cost, s.Language([t or "" for _, t in rows] + ["some context"]).cost)
