"""op6, op7 and op8 against brute force and exact round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from skarn.llm import exact_dedup, packing, sharding
from skarn.llm.bpe import Ids

SCHEMA = "doc_id long, text string, cell int, h string, rank long, key string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 1, "h", 2, "k", 3) for a, b in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    made = [(i, " ".join(rnd.choice(["The", "fox's", "naïve", "x1,", "ÉTÉ!", "a.b@c", "<|endoftext|>", "ÅΣ", "é", "12 34"]) for _ in range(rnd.choice([1, 3, 50, 700])))) for i in range(120)]
    made += [(200 + i, made[0][1]) for i in range(90)] + [(300, made[0][1] + "\n"), (301, None), (302, ""), (303, " \t"), (303, " \t"), (304, "long " * 30_000), (None, "no id")]
    return made


def test_exact_duplicates_match_sql(spark, rows):
    got = sorted((tuple(r) for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect()), key=str)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert got == sorted(con.execute(exact_dedup.ORACLE_SQL["op7_exact_dedup"]).fetchall(), key=str)
    by = {(r[0], r[4]): r for r in got}
    h = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", rows[0][1]).encode()).hexdigest()
    assert by[300, h][1] == 300 and by[200, h][2] >= 91


def test_exact_duplicates_of_nothing(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).collect() == []


def test_shards_are_even_and_gapless(spark, rows):
    got = sharding.shard_rows(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((a, len((b or "").encode()) + 1, zlib.crc32((b or "").encode())) for a, b in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_rows(frame(spark, [])).collect() == []


def test_cells_of_many_rows(spark, rows, monkeypatch):
    """One doc_id on a third of the rows, and rows without one."""
    monkeypatch.setattr(sharding, "LARGE", 20)
    monkeypatch.setattr(sharding, "UNEVEN", 1)
    monkeypatch.setattr(sharding, "PARTS", 7)
    some = rows[:200] + [(7, f"text {i % 30}") for i in range(130)] + [(None, None)] * 60
    got = sharding.shard_rows(frame(spark, some)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((a, len((b or "").encode()) + 1) for a, b in some)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_ring_moves_little():
    rnd = random.Random(0)
    counts = Counter(rnd.randrange(sharding.CELLS) for _ in range(200_000))

    def of(shards):
        out = {}
        for cell, lo, hi, shard, _ in sharding.segments(counts, shards):
            for r in range(lo, hi):
                out[cell, r] = shard
        return out

    a, b = of(8), of(9)
    moved = sum(a[k] != b[k] for k in a)
    assert moved < 0.35 * len(a)  # a new even layout by modulus moves 8 / 9
    home = sharding.owners(8)
    at = np.searchsorted(home[:, 0], [k[0] for k in a]) % len(home)
    assert np.mean(home[at, 1] == np.array(list(a.values()))) > 0.75


def test_cached_words_are_the_tokenizers_ids(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    plain, ours = Tokenizer.from_file(path), Ids.of(path)
    texts = [r[1] or "" for r in rows] + ["a b", "x\x1cy", "́a b", "İi ΑΣ ΑΣ.", "'s 's' don't", "٣٤ ½ ª.ª", "ℌ!a", "..a..b!!", "(a'll)", "≠ a", "a\r\nb c"]
    texts += ["Plain text, 12 words; ÀÉß þÿ×÷ ü!", "x" * 90 + " ok", "", "\x00\x01 a\x7f", "Ünïcödé##", "9 9a a9", "a\u00a0b", "tab\tand\x0bmore"]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.ids(data, at)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_fill_is_a_subset_sum():
    rnd = random.Random(9)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(5)}
        target = rnd.randint(1, 60)
        sums = {0}
        for k, v in counts.items():
            sums = {s + k * i for s in sums for i in range(v + 1)}
        used = packing.fill(sorted(counts, reverse=True), counts, target)
        assert all(v <= counts[k] for k, v in used.items())
        assert sum(k * v for k, v in used.items()) == max(s for s in sums if s <= target)


def test_packing_round_trip(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    got = packing.pack(frame(spark, rows)).collect()
    want = defaultdict(list)
    for doc, text in rows:
        want[doc].append(plain.encode(text or "", add_special_tokens=False).ids + [2])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, texts in want.items():
        own = pieces[doc]
        assert sum(p.length for p in own) == sum(map(len, texts))
        for p in own:
            assert any(len(t) == p.doc_tokens and zlib.crc32(np.array(t[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for t in texts)
        if len(texts) == 1:
            assert sorted(x for p in own for x in range(p.start, p.start + p.length)) == list(range(len(texts[0])))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(frame(spark, [])).collect() == []


def test_ids_of_words_that_a_polynomial_confuses():
    public_tokenizers = pytest.importorskip("public_tokenizers")

    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    made = Ids(public_tokenizers.path(packing.VOCABULARY))
    texts = [word, word.translate(str.maketrans("ab", "ba"))]
    raw = [x.encode() for x in texts]
    got = made.ids(np.frombuffer(b"".join(raw), np.uint8), np.array([0, 1024, 2048]))
    assert got == [np.array(made.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts] and got[0] != got[1]
