"""Personal data: exact base spans, and more of them by bootstrapped contextual extraction.

Base spans (code points, leftmost and non-overlapping within each kind, failing matches
dropped without retries) come from one pass of built-in functions over each whole text:

- email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`
- ip `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)` with parts at most 255
- card `[0-9]([\\x20-]?[0-9])+` with 13 to 19 digits that pass Luhn
- phone `\\+[0-9][\\x20().0-9-]+[0-9]` with 9 to 15 digits

The patterns that run are rewritten so that each text is scanned in linear time and
without recursion (separators inside a match are first replaced by a mark).

Bootstrapping: candidates are tokens with a digit, of 5 characters or more, and
those without an ASCII letter are joined over blanks and the separators `( ) . / -`; a run that overlaps a base span is taken
token by token. A candidate's lexical pattern is the one or two words before it. Base matches seed the pattern-instance
graph. In each round a pattern scores, for a kind, the mean confidence of its
instances (each distinct instance counts once), and an unseen instance the mean score of
its patterns. An unseen instance of MIN_SCORE counts as a seed in the next round, so what one
pattern discovers can make another one trusted; rounds go on until none is, ROUNDS at most.
Patterns with MIN_SEEDS distinct seeds of one kind and a score of MIN_SCORE
mark the candidates behind them; a mark that overlaps a base span is dropped. Pattern and
instance statistics cover all documents and are combined before each shuffle.

Null counts as empty. Repeated rows get equal results. Empty tables give empty results;
other columns are ignored. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

KINDS = ("email", "ip", "card", "phone")
#: Rounds at most; they end as soon as no pattern is newly trusted.
ROUNDS = 6
MIN_SEEDS = 5
MIN_SCORE = 0.9

_CUT, _JOIN = "\x01", "\x03"
_SPAN = "struct<start:int,end:int,s:string>"
_TYPED = "array<struct<kind:string,start:int,end:int>>"
_EMAIL = f"(?:\\G|(?<![A-Za-z0-9._%+\\-{_JOIN}]))[A-Za-z0-9._%+\\-{_JOIN}]++@[A-Za-z0-9-]++{_JOIN}[A-Za-z0-9\\-{_JOIN}]++"
_IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
_CARD = f"(?<![0-9{_JOIN}])[0-9{_JOIN}]{{13,}}+"
_PHONE = "\\+[0-9][ ().0-9-]+[0-9]"
_NUMBER = "(?<!\\S)(?=[^\\sA-Za-z]*[0-9])[^\\sA-Za-z]++(?!\\S)"
_MIXED = "(?<!\\S)(?=\\S*[0-9])(?=\\S*[A-Za-z])\\S++"
#: between two marked numbers of one run
_GAP = f"{_CUT}([ \\t()./-]++){_CUT}"
_CAND = "struct<start:int,end:int,s:string,before:string>"


def _fold(parts: Column, at: Column, before: Column, short: int, kind: str, span) -> Column:
    """Every second part with its place, a struct of type kind made by span(start, end, part, before).

    Parts are folded in blocks, of about the root of their number where there are many, for
    an append copies the array: the cost stays near the length of the text. before is the
    last 60 code points in front of a part.
    """
    # parts, bound once: the blocks would scan the text again each
    return F.get(F.transform(F.array(parts), lambda p: _blocks(p, at, before, short, kind, span)), F.lit(0))


def _blocks(parts: Column, at: Column, before: Column, short: int, kind: str, span) -> Column:
    n = F.size(parts)
    size = F.greatest(F.lit(256), (F.ceil(F.sqrt(n.cast("double")) / 2) * 2).cast("int"))  # even: a block begins with a gap
    tail = lambda x: F.right(x, F.lit(60))

    def block(b: Column) -> Column:
        lead = F.when(b == 0, before).otherwise(tail(F.concat(before, F.array_join(F.slice(parts, F.greatest(b * size - 59, F.lit(1)), F.least(b * size, F.lit(60))), ""))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("found"), F.lit(False).alias("odd"), lead.alias("before"))

        def step(acc: Column, part: Column) -> Column:
            end = acc["at"] + F.length(part)
            found = F.when(acc["odd"] & (F.length(part) >= short), F.array_append(acc["found"], span(acc["at"], end, part, acc["before"]))).otherwise(acc["found"])
            return F.struct(end.alias("at"), found.alias("found"), (~acc["odd"]).alias("odd"), tail(F.concat(acc["before"], tail(part))).alias("before"))

        return F.aggregate(F.slice(parts, b * size + 1, size), start, step, lambda acc: F.struct(acc["at"].alias("n"), acc["found"].alias("found")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), block)
    begin = F.struct(at.alias("at"), F.array().cast(f"array<struct<at:int,found:array<{kind}>>>").alias("all"))
    placed = F.aggregate(blocks, begin, lambda acc, b: F.struct((acc["at"] + b["n"]).alias("at"), F.array_append(acc["all"], F.struct(acc["at"].alias("at"), b["found"].alias("found"))).alias("all")), lambda acc: acc["all"])
    moved = lambda m, by: m.withField("start", m["start"] + by).withField("end", m["end"] + by)
    return F.flatten(F.transform(placed, lambda b: F.transform(b["found"], lambda m: moved(m, b["at"]))))


def _matches(text: Column, pattern: str) -> Column:
    """The matches as (start, end, s), by cutting the text at each match's ends."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_CUT}$0{_CUT}"), _CUT)
    return _fold(parts, F.lit(0), F.lit(""), 0, _SPAN, lambda a, b, s, _: F.struct(a.alias("start"), b.alias("end"), s.alias("s")))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    ds = F.reverse(F.split(digits, ""))
    # every second digit from the right is doubled, and 9 taken off above 9
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    each = F.transform(ds, lambda d, i: F.when(i % 2 == 1, twice(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> array of (start, end, s) of a text without marks."""
    dots = F.regexp_replace(text, "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])", _JOIN)
    gaps = F.regexp_replace(text, "(?<=[0-9])[ -](?=[0-9])", _JOIN)
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    small = lambda p: (F.length(bare(p)) <= 3) & (F.substring(bare(p), 1, 3).cast("int") <= 255)
    return {
        "email": F.when(text.contains("@"), _matches(dots, _EMAIL)).otherwise(_none()),
        "ip": F.when(text.rlike("[0-9]\\.[0-9]"), F.filter(_matches(text, _IP), lambda m: F.forall(F.split(m["s"], "\\."), small))).otherwise(_none()),
        "card": F.when(gaps.rlike(f"[0-9{_JOIN}]{{13}}"), F.filter(_matches(gaps, _CARD), lambda m: F.length(_digits(m["s"])).between(13, 19) & _luhn(_digits(m["s"])))).otherwise(_none()),
        "phone": F.when(text.contains("+"), F.filter(_matches(text, _PHONE), lambda m: F.length(_digits(m["s"])).between(9, 15))).otherwise(_none()),
    }


def _left(text: Column) -> Column:
    """The last one or two words of a text, lower-cased."""
    words = F.filter(F.split(F.lower(F.right(text, F.lit(60))), "\\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), " ")


def candidates(text: Column, at: Column | None = None, before: Column | None = None, joined: bool = True) -> Column:
    """Runs of tokens with digits, or single ones, and the text before them: (start, end, s, before)."""
    marked = F.regexp_replace(text, _NUMBER, f"{_CUT}$0{_CUT}")
    marked = F.regexp_replace(marked, _GAP, "$1") if joined else marked
    parts = F.split(F.regexp_replace(marked, _MIXED, f"{_CUT}$0{_CUT}"), _CUT)
    span = lambda a, b, s, before: F.struct(a.alias("start"), b.alias("end"), s.alias("s"), before.alias("before"))
    return _fold(parts, F.lit(0) if at is None else at, F.lit("") if before is None else before, 5, _CAND, span)


def bootstrap(edges: DataFrame) -> DataFrame:
    """Trusted (left, kind) of edges (left, s, kind or null): patterns scored by their instances, and back."""
    graph = saved(edges.groupBy("left", "s").agg(F.max("kind").alias("kind")), "graph")
    sizes = graph.groupBy("left").agg(F.count("*").alias("size"))
    known = graph.where("kind is not null").select("left", F.col("kind").alias("k"))
    unseen = scores = trusted = None
    for _ in range(ROUNDS):
        seeds = known
        if unseen is not None:
            seeds = known.unionByName(graph.where("kind is null").join(unseen.where(f"conf >= {MIN_SCORE}"), "s").select("left", "k"))
        # only patterns with enough seeds can come to be trusted; all their instances take part
        seeds = seeds.groupBy("left", "k").agg(F.count("*").alias("seeds")).where(f"seeds >= {MIN_SEEDS}")
        own = graph.join(seeds, "left").join(sizes, "left")
        own = own.withColumn("conf", F.lit(0.0)) if unseen is None else own.join(unseen, ["s", "k"], "left")
        own = own.withColumn("c", F.when(F.col("kind") == F.col("k"), 1.0).when(F.col("kind").isNotNull(), 0.0).otherwise(F.coalesce("conf", F.lit(0.0))))
        scores = saved(own.groupBy("left", "k").agg((F.sum("c") / F.max("size")).alias("score"), F.max("seeds").alias("seeds")), "scores")
        unseen = saved(graph.where("kind is null").join(scores.select("left", "k", "score"), "left").groupBy("s", "k").agg(F.avg("score").alias("conf")), "instances")
        before, trusted = trusted, scores.where(f"score >= {MIN_SCORE}").count()
        if trusted == before:
            break
    return scores.where(f"score >= {MIN_SCORE}").select("left", F.col("k").alias("kind"))


def _typed(kind: str) -> Column:
    return F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def _seeds(kind: str) -> Column:
    before = lambda m: F.substring(F.col("t"), F.greatest(m["start"] - 59, F.lit(1)), F.least(m["start"], F.lit(60)))
    return F.transform(kind, lambda m: F.struct(_left(before(m)).alias("left"), m["s"].alias("s"), F.lit(kind).alias("kind")))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.array_sort(F.filter(spans, lambda m: m["kind"] == kind))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found) for each row."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = F.translate(raw, _CUT + _JOIN, "\x02\x02")
    id_ = F.col(id_col).cast("long")
    rows = docs.select(id_.alias("doc_id"), F.xxhash64(id_, raw).alias("row"), F.xxhash64(raw).alias("key"), text.alias("t"))
    spans = base_spans(F.col("t"))
    rows = rows.select("doc_id", "row", "key", *[v.alias(k) for k, v in spans.items()], "t")
    rows = saved(rows.select("doc_id", "row", "key", *KINDS, F.concat(*[_seeds(k) for k in KINDS]).cast("array<struct<left:string,s:string,kind:string>>").alias("seeds"), F.when(F.col("t").rlike("[0-9]"), candidates(F.col("t"))).alias("cands")), "spans")
    typed = F.concat(*[_typed(k) for k in KINDS]).cast(_TYPED)
    hits = rows.select("row", "key", typed.alias("base"), F.explode("cands").alias("c")).select("row", "key", "base", "c.*")
    over = F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    hits = hits.withColumn("over", over)
    single = candidates(F.col("s"), F.col("start"), F.col("before"), joined=False)
    parts = hits.where("over").select("row", "key", "base", F.explode(single).alias("c")).select("row", "key", "base", "c.*").where(~over)
    columns = ["row", "key", "start", "end", "s", "before"]
    hits = hits.where("not over").select(*columns).unionByName(parts.select(*columns)).withColumn("left", _left(F.col("before"))).drop("before").where("left <> ''")
    hits = saved(hits, "candidates")
    seeds = rows.select(F.explode("seeds").alias("c")).where("c.left <> ''").select("c.left", "c.s", "c.kind")
    trusted = bootstrap(hits.select("left", "s", F.lit(None).cast("string").alias("kind")).unionByName(seeds))
    found = hits.join(trusted.withColumnRenamed("kind", "k"), "left").groupBy("row", "key").agg(F.collect_set(F.struct(F.col("k").alias("kind"), "start", "end")).alias("found"))
    # the join is by row content: rows that repeat share it
    joined = rows.join(found, ["row", "key"], "left")
    nothing = F.array().cast(_TYPED)
    joined = joined.withColumn("base", typed).withColumn("found", F.coalesce("found", nothing))

    def listed(spans: Column) -> Column:
        by_kind = [_of_kind(spans, k) for k in KINDS]
        return F.array_join(F.transform(F.concat(*by_kind), lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")

    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return joined.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "found")).alias("spans"), "found")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("found")
