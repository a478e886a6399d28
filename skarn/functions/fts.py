"""Full text: lexers by language, postings, web-style queries, rank."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import stems

LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}
#: A language with its stop words but without stems.
EXACT = "_exact"
#: All configurations; chunks of any other are simple.
CONFIGS = ["simple", *LANGUAGES.values(), *[c + EXACT for c in LANGUAGES.values()]]
_ZETA2 = 1.64493406685
MAX_TF = 255


def known(config: Column) -> Column:
    """A chunk's configuration, simple where it is none of CONFIGS."""
    return F.when(config.isin(CONFIGS), config).otherwise("simple")


def tokens(text: Column) -> Column:
    """Words of letters and digits in lower case, in order (the 'simple' configuration)."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def stop_words(config: str) -> list[str]:
    """The stop list of a language as Spark ships it; none for others."""
    from pyspark.ml.feature import StopWordsRemover

    try:
        return [] if config == "simple" else list(StopWordsRemover.loadDefaultStopWords(config.removesuffix(EXACT)))
    except Exception:  # noqa: BLE001  py4j reports unknown languages by several types
        return []


_VOWEL = re.compile("[aeiouy]")


def _measure(stem: str) -> int:
    form = re.sub("c+", "C", re.sub("v+", "V", "".join("v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem))))
    return form.count("VC")


def porter(word: str) -> str:
    """The Porter stemmer (1980), the forerunner of stems.english."""
    w = word
    if len(w) < 3 or not w.isascii():
        return w
    vowel = lambda s: any(c in "aeiou" or (c == "y" and i and s[i - 1] not in "aeiou") for i, c in enumerate(s))
    cons = lambda s, i: not (s[i] in "aeiou" or (s[i] == "y" and i > 0 and cons(s, i - 1)))
    cvc = lambda s: len(s) > 2 and cons(s, len(s) - 1) and not cons(s, len(s) - 2) and cons(s, len(s) - 3) and s[-1] not in "wxy"
    for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(a):
            w = w[: len(w) - len(a)] + b
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for a in ("ed", "ing"):
            if w.endswith(a) and vowel(w[: -len(a)]):
                w = w[: -len(a)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and cons(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    # The suffix lists of steps 2, 3 and 4.
    steps = [
        (0, [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]),
        (0, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]),
        (1, [(s, "") for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")]),
    ]
    for least, rules in steps:
        for a, b in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(a):
                keep = 3 if a in ("sion", "tion") else len(a)
                stem = w[: len(w) - keep]
                if _measure(stem) > least:
                    w = stem + b
                break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def postings(chunks: DataFrame, config: str | Column = "simple", id_col: str = "chunk_id", text_col: str = "content", carry: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, lexeme, tf, positions) and the carried columns: positions from 1, counted before stop words go."""
    words = chunks.select(id_col, *carry, F.posexplode(tokens(F.col(text_col))).alias("p", "lexeme"))
    if isinstance(config, str) and config != "simple":
        words = words.where(~F.col("lexeme").isin(stop_words(config)))
        if config in stems.STEMMERS:
            words = words.withColumn("lexeme", stems.stemmed("lexeme", F.lit(config)))
    return words.groupBy(id_col, "lexeme").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list(F.col("p") + 1)).alias("positions"), *[F.first(c).alias(c) for c in carry])


Query = list[list[tuple[bool, list[str | None]]]]


def parse_query(text: str, config: str = "simple") -> Query:
    """A web-style query as alternatives of (negated, phrase words): AND by default, or, quotes, minus.

    Stop words of the language go; inside a phrase None keeps their place.
    """
    groups: Query = [[]]
    stops = set(stop_words(config))
    for sign, quoted, phrase, word in re.findall(r'(-?)(?:("([^"]*)")|(\S+))', text):
        if word.lower() == "or" and not sign:
            groups.append([])
            continue
        found: list[str | None] = [None if w in stops else stems.stem(w, config) for w in re.split(r"[^\w]+|_", (phrase if quoted else word).lower()) if w]
        while found and found[0] is None:
            found.pop(0)
        while found and found[-1] is None:
            found.pop()
        if found:
            groups[-1].append((sign == "-", found))
    return [g for g in groups if g]


def grouped(queries: dict) -> list[tuple[list, Query]]:
    """Queries by configuration, those that read alike together."""
    out: dict[str, tuple[list, Query]] = {}
    for config, query in queries.items():
        out.setdefault(repr(query), ([], query))[0].append(config)
    return list(out.values())


def words_of(query: Query) -> list[str]:
    return sorted({w for g in query for _, p in g for w in p if w is not None})


def _every(xs: list[Column]) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & x
    return out


def matches(query: Query, at: Callable[[str], Column]) -> Column:
    """Whether a row matches; at(word) gives the word's positions in it, an array."""

    def phrase(p: list[str | None]) -> Column:
        if len(p) == 1:
            return F.size(at(p[0])) > 0
        return F.exists(at(p[0]), lambda i: _every([F.array_contains(at(w), i + k) for k, w in enumerate(p) if k and w is not None]))

    ok = F.lit(False)
    for g in query:
        ok = ok | _every([~phrase(p) if neg else phrase(p) for neg, p in g])
    return ok


def rank(query: Query, at: Callable[[str], Column]) -> Column:
    """Rank of a row by the query's words, default weights, no normalisation.

    Alternatives, and single words, add falling weights of occurrences over the number of
    words; words that must all occur are ranked by the distances of their first
    MAX_TF occurrences, near ones weighing more.
    """
    words = words_of(query)
    if not words:
        return F.lit(0.0)
    if len(words) == 1 or len(query) > 1:
        table = weight_table()
        total = F.lit(0.0)
        for w in words:
            total = total + F.get(table, F.least(F.size(at(w)), F.lit(MAX_TF)))
        return F.round(total / len(words), 9)
    held = {w: F.slice(at(w), 1, MAX_TF) for w in words}
    total = F.lit(0.0)
    for i, x in enumerate(words):
        for y in words[i + 1 :]:
            total = total + _distances(held[x], held[y])
    return F.round(F.greatest(F.lit(1.0) - F.exp(total), F.lit(1e-20)), 9)


def _distances(x: Column, y: Column) -> Column:
    """The weights of all pairs of two lists of positions, summed."""
    return F.aggregate(x, F.lit(0.0), lambda s, p: s + F.aggregate(y, F.lit(0.0), lambda t, q: t + F.when(p == q, 0.0).otherwise(_pair(F.abs(p - q)))))


def _pair(d: Column) -> Column:
    near = F.when(d > 100, F.lit(1e-30)).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
    return F.log(F.lit(1.0) - F.sqrt(0.1 * 0.1 * near))


def evaluate(index: DataFrame, query: Query, id_col: str = "chunk_id") -> DataFrame:
    """Ids of chunks that match: postings of the query's words only, gathered for each chunk."""
    return matched(index, {None: query}, id_col).select(id_col)


def matched(index: DataFrame, queries: dict[str | None, Query], id_col: str = "chunk_id") -> DataFrame:
    """(id, rank) of chunks that match the query of their language (fts_config; None: of any).

    Only postings of the queries' words are read and gathered. A chunk that holds none of
    them has no postings, so alternatives of negations alone find what holds others.
    """
    none = F.array().cast("array<int>")
    wanted, ok, score = F.lit(False), F.lit(False), F.lit(0.0)
    at = lambda w: F.coalesce(F.try_element_at("m", F.lit(w)), none)
    for configs, query in grouped(queries):
        words = words_of(query)
        own = F.lit(True) if None in configs else F.col("fts_config").isin(configs)
        if not words:
            continue
        wanted = wanted | (own & F.col("lexeme").isin(words))
        ok = F.when(own, matches(query, at)).otherwise(ok)
        score = F.when(own, rank(query, at)).otherwise(score)
    keys = [id_col] if None in queries else [id_col, "fts_config"]
    have = index.where(wanted).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "positions"))).alias("m"))
    return have.where(ok).select(id_col, score.alias("rank"))


def term_weight(tf: Column) -> Column:
    """Falling weights of a term's occurrences, 1, 1/4, 1/9, ..."""
    return F.aggregate(F.sequence(F.lit(1), F.least(tf.cast("int"), F.lit(MAX_TF))), F.lit(0.0), lambda s, j: s + F.lit(1.0) / (j * j)) * 0.1 / _ZETA2


def weights() -> list[float]:
    """term_weight of 0 to MAX_TF occurrences."""
    out, total = [0.0], 0.0
    for j in range(1, MAX_TF + 1):
        total += 1.0 / (j * j)
        out.append(total * 0.1 / _ZETA2)
    return out


def weight_table() -> Column:
    """The weights as one constant, of four nodes in a plan however many words a query has."""
    return F.split(F.lit(",".join(map(repr, weights()))), ",").cast("array<double>")


def rank_any(index: DataFrame, words: list[str], id_col: str = "chunk_id") -> DataFrame:
    """(chunk_id, rank): default weights, no normalisation, for single and OR terms."""
    return index.where(F.col("lexeme").isin(words)).groupBy(id_col).agg(F.round(F.sum(term_weight(F.col("tf"))) / len(words), 9).alias("rank"))


def rank_all(index: DataFrame, words: list[str], id_col: str = "chunk_id") -> DataFrame:
    """(chunk_id, rank) for AND terms, of chunks that hold two of them at least."""
    query: Query = [[(False, [w]) for w in words]]
    at = lambda w: F.coalesce(F.try_element_at("m", F.lit(w)), F.array().cast("array<int>"))
    have = index.where(F.col("lexeme").isin(words)).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "positions"))).alias("m"))
    return have.where(F.size("m") > 1).select(id_col, rank(query, at).alias("rank"))


def stored(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """Postings of all chunks, each in its own language (fts_config), for the store.

    shard is a hash of the lexeme: written with partitionBy("shard"), a search reads the
    shards of its words only.
    """
    return by_language(chunks, id_col, text_col, ("source_id",)).withColumn("shard", shard(F.col("lexeme")))


def by_language(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content", carry: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, lexeme, tf, positions, fts_config) and the carried columns, each chunk in its own language; unknown ones are simple.

    Two scans: only tokens of languages with a stemmer leave the JVM.
    """
    config = known(F.col("fts_config"))
    rows = chunks.select(id_col, *[c for c in carry if c != id_col], F.col(text_col), config.alias("fts_config"))
    words = rows.select(id_col, *carry, "fts_config", F.posexplode(tokens(F.col(text_col))).alias("p", "lexeme"))
    for c in LANGUAGES.values():
        words = words.where(~F.col("fts_config").isin([c, c + EXACT]) | ~F.col("lexeme").isin(stop_words(c)))
    has_stems = F.col("fts_config").isin(list(stems.STEMMERS))
    kept = [F.first(c).alias(c) for c in (*carry, "fts_config")]

    def by(rows: DataFrame) -> DataFrame:
        return rows.groupBy(id_col, "lexeme").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list(F.col("p") + 1)).alias("positions"), *kept)

    return by(words.where(~has_stems)).unionByName(by(words.where(has_stems).withColumn("lexeme", stems.stemmed("lexeme", "fts_config"))))


def words(text: Column, config: Column) -> Column:
    """The words of a text as its language indexes them, each at its place; stop words leave theirs empty.

    Only texts of languages with a stemmer leave the JVM.
    """
    found = tokens(text)
    kept = found
    without = lambda stops: F.transform(found, lambda x: F.when(x.isin(stops), "").otherwise(x))
    for c in LANGUAGES.values():
        kept = F.when(config.isin([c, c + EXACT]), without(stop_words(c))).otherwise(kept)
    has_stems = config.isin(list(stems.STEMMERS))
    return F.when(has_stems, stems.stemmed_once(F.when(has_stems, kept), config)).otherwise(kept)


SHARDS = 64


def shard(lexeme: Column) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(SHARDS)).cast("int")


def shards_of(spark, words: list[str]) -> list[int]:
    """The shards of some words."""
    if not words:
        return []
    return sorted({r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(shard(F.col("w"))).collect()})
