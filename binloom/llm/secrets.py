"""Secret scans: pattern kinds plus strings that a character Markov model finds random.

Two first-order character models are trained from labelled samples (random strings, ordinary identifiers). A candidate is
a run of key characters. The log-likelihood ratio of the two models is summed along it, floored at 0, so that ordinary
words before or after a key take nothing from it; what rises high enough, more so in long runs, becomes a span if it has
letters and digits side by side. The sum stands no higher than it must rise, so ordinary words between two keys part them. A span
reaches to the next '/', '_' or '-' on both sides; a run that is as random as a whole is one span. Everything is DataFrame expressions: the trained table has 65 * 65
entries whatever the corpus.

Defined results: a null text counts as empty and has no spans; repeated rows each get their own row; an empty table
gives an empty table; columns other than the text are carried along under any name (one named as the output column is replaced).
Positions are code points, the end exclusive. Markov spans are found in what base spans leave of a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: kind: (pattern, group whose length counts, least length). Order breaks ties between spans with one start.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: A cheap test that any text with a match of the kind passes.
HINT = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
CANDIDATE = r"[A-Za-z0-9+/_-]{12,}={0,2}"
#: Characters of a run up to which the least ratio holds as it is; beyond, its logarithm is added.
RUN = 20
#: Characters of a neighbouring word that a stretch may reach into without taking it.
TOUCH = 2
#: Share of the next character that doesn't depend on the one before it.
BACKED = 0.1
#: A letter and a digit with no separator between them; words and numbers that separators part aren't one string.
MIXED = r"[A-Za-z]\+*[0-9]|[0-9]\+*[A-Za-z]"
STRETCH = "array<struct<from:int,to:int,score:double>>"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
KINDS = [*BASE, "markov"]
MASK = "[SECRET]"
SPAN = "array<struct<start:bigint,end:bigint,rank:int,kind:string,score:double>>"

#: Fixed words that ordinary identifiers are made of.
PARTS = (
    "get set user name file path index count total value key list map data table row column page item size length width height "
    "start end first last next prev max min sum avg time date year month day hour update delete insert create remove open close "
    "read write load save parse format print debug error warning config option default custom client server request response "
    "header footer body content type class method function module package import export test build release version"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Training rows (sample string, random boolean), n of each label: digests in hex, base64 and base36, and joined words."""
    ids = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    upper = F.conv(F.substring(digest, 1, 12), 16, 36)
    drawn = F.when(F.col("id") % 4 == 0, digest).when(
        F.col("id") % 4 == 1, F.concat(upper, F.conv(F.substring(digest, 13, 12), 16, 36), F.conv(F.substring(digest, 25, 12), 16, 36))
    )
    drawn = drawn.otherwise(F.base64(F.unhex(digest)))
    parts = F.array(*[F.lit(x) for x in PARTS])
    part = lambda k: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    number = F.when(F.col("id") % 3 == 0, (F.col("id") % 2030).cast("string")).otherwise("")
    words = [part(k) for k in range(4)]
    joined = (
        F.when(F.col("id") % 4 == 0, F.concat_ws("_", *words))
        .when(F.col("id") % 4 == 1, F.concat_ws("-", *words))
        .when(F.col("id") % 4 == 2, F.concat(words[0], *[F.initcap(w) for w in words[1:]]))
        .otherwise(F.concat_ws("/", *words))
    )
    return ids.select(drawn.alias("sample"), F.lit(True).alias("random")).union(
        ids.select(F.concat(joined, number).alias("sample"), F.lit(False).alias("random"))
    )


def train(samples: DataFrame, smoothing: float = 0.5, backed: float = BACKED) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random over ordinary, row by row over ALPHABET and one class for the rest.

    A share of what follows a character is drawn whatever it follows, so that pairs of words that the samples lack are
    rare, not impossible. At most 2 * 65 * 65 counted rows reach the driver, whatever the number of samples. Null samples are ignored.
    """
    k = len(ALPHABET) + 1
    at = lambda i: F.expr(f"instr('{ALPHABET}', substring(sample, {i}, 1))")
    rows = (
        samples.where(F.length("sample") > 1)
        .select("random", "sample", F.explode(F.sequence(F.lit(1), F.length("sample") - 1)).alias("i"))
        .groupBy("random", at("i").alias("x"), at("i + 1").alias("y"))
        .count()
        .collect()
    )
    counts = {True: [smoothing] * (k * k), False: [smoothing] * (k * k)}
    for r in rows:
        counts[r.random][r.x * k + r.y] += r["count"]
    log_p = {}
    for label, c in counts.items():
        after = [sum(c[x * k + y] for x in range(k)) for y in range(k)]
        total = [sum(c[x * k : (x + 1) * k]) for x in range(k)]
        log_p[label] = [math.log((1 - backed) * c[i] / total[i // k] + backed * after[i % k] / sum(after)) for i in range(k * k)]
    return [x - y for x, y in zip(log_p[True], log_p[False], strict=True)]


def pair_ratios(string: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of each two neighbours."""
    k = len(ALPHABET) + 1
    at = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    table = F.array(*[F.lit(x) for x in model])
    return F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda x, y: F.element_at(table, x * k + y + 1))


def log_ratio(string: Column, model: list[float]) -> Column:
    return F.aggregate(pair_ratios(string, model), F.lit(0.0), lambda s, x: s + x)


def stretches(string: Column, model: list[float], least_ratio: float) -> Column:
    """Array of (from, to, score): the parts of a run that are random enough, widened to separators, none overlapping."""
    least = F.lit(least_ratio) + F.log(F.greatest(F.length(string), F.lit(RUN)) / F.lit(float(RUN)))
    none = F.array().cast(STRETCH)
    state = lambda i, s, top, total, score, start, end, done: F.struct(
        i.alias("i"), s.alias("s"), top.alias("top"), total.alias("total"), score.alias("score"), start.alias("from"), end.alias("to"), done.alias("done")
    )
    zero, nought = F.lit(0.0), F.lit(0)
    stretch = lambda a: F.array(F.struct(a["from"].alias("from"), a["to"].alias("to"), a["score"].alias("score")))
    ended = lambda a: F.when(a["top"] >= least, F.concat(a["done"], stretch(a))).otherwise(a["done"])

    def step(a, x):
        i, s, total = a["i"] + 1, F.least(a["s"] + x, least), a["total"] + x
        start = F.when(a["s"] > 0, a["from"]).otherwise(a["i"])
        # a sum that comes back to the cap is as high as it was
        risen = state(i, s, s, total, total, start, i + 1, a["done"])
        fallen = state(i, s, a["top"], total, a["score"], start, a["to"], a["done"])
        return F.when(s <= 0, state(i, zero, zero, zero, zero, i, i, ended(a))).when(s >= a["top"], risen).otherwise(fallen)

    found = F.aggregate(pair_ratios(string, model), state(nought, zero, zero, zero, zero, nought, nought, none), step, ended)
    # a run that is as random as its stretches, but for a quarter, is one key
    total = F.aggregate(found, zero, lambda t, x: t + x["score"])
    whole = F.array(F.struct(nought.alias("from"), F.length(string).alias("to"), log_ratio(string, model).alias("score")))
    found = F.when((F.size(found) > 0) & (log_ratio(string, model) >= 0.75 * total), whole).otherwise(found)
    length = lambda part, pattern: F.length(F.regexp_extract(part, pattern, 0))
    # at both ends, what the stretch has of the last segment, and what is left of it; a mere touch of a word is given back
    head = lambda x: length(F.substring(string, x["from"] + 1, x["to"] - x["from"]), r"\A[^/_-]*")
    tail = lambda x: length(F.substring(string, x["from"] + 1, x["to"] - x["from"]), r"[^/_-]*\z")
    before = lambda x: length(F.substring(string, F.lit(1), x["from"]), r"[^/_-]*\z")
    behind = lambda x: length(F.substring(string, x["to"] + 1, F.length(string)), r"\A[^/_-]*")
    start = lambda x: F.when((head(x) <= TOUCH) & (before(x) > TOUCH), x["from"] + head(x) + 1).otherwise(x["from"] - before(x))
    end = lambda x: F.when((tail(x) <= TOUCH) & (behind(x) > TOUCH), x["to"] - tail(x) - 1).otherwise(x["to"] + behind(x))
    wide = F.transform(found, lambda x: F.struct(start(x).alias("from"), end(x).alias("to"), x["score"].alias("score")))

    def joined(done, x):
        last = F.element_at(done, -1)
        both = F.struct(last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"), F.greatest(last["score"], x["score"]).alias("score"))
        overlap = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["to"] > x["from"])
        return F.when(overlap, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(wide, none, joined)


def _found(df: DataFrame, text: str, kind: str, pattern: str, hint: str) -> DataFrame:
    """Columns _m (matches) and _s (their starts), from the matches and the pieces between them."""
    has = F.col(text).rlike(hint)
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)).withColumn(
        "_gap", F.when(F.size("_m") > 0, F.split(text, pattern, -1)).otherwise(none)
    )
    step = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    walk = F.aggregate(
        F.zip_with(F.slice("_gap", 1, F.greatest(F.size("_m"), F.lit(1))), "_m", lambda g, m: F.struct(F.length(g).cast("bigint").alias("g"), F.length(m).cast("bigint").alias("m"))),
        step,
        lambda s, x: F.struct((s["at"] + x["g"] + x["m"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["g"])).alias("starts")),
        lambda s: s["starts"],
    )
    return df.withColumn("_s", F.when(F.size("_m") > 0, walk).otherwise(F.array().cast("array<bigint>"))).drop("_gap")


def _spans(kind: str, keep) -> Column:
    rank = KINDS.index(kind)
    one = F.zip_with(
        "_s",
        "_m",
        lambda s, m: F.struct(
            s.alias("start"), (s + F.length(m)).cast("bigint").alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            F.lit(None).cast("double").alias("score"), keep(m).alias("keep"),
        ),
    )
    bare = lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "rank", "kind", "score")])
    return F.transform(F.filter(one, lambda x: x["keep"]), bare).cast(SPAN)


def scan(docs: DataFrame, model: list[float], text: str = "text", out: str = "secrets", least_ratio: float = 12.0) -> DataFrame:
    """The rows of docs with their spans (start, end, rank, kind, score), ordered by start, then kind."""
    kept = [c for c in docs.columns if c != out]
    df = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    for kind, (pattern, group, least) in BASE.items():
        df = _found(df, "_text", kind, pattern, HINT[kind])
        long = lambda m, p=pattern, g=group, n=least: F.length(F.regexp_extract(m, p, g)) >= n
        df = df.withColumn(f"_{kind}", _spans(kind, long)).drop("_m", "_s")
    df = df.withColumn("_base", F.concat(*[f"_{k}" for k in BASE])).drop(*[f"_{k}" for k in BASE])
    # base spans are blanked, so that what a run has on either side of one is a run of its own at the same place
    df = df.withColumn("_text", F.when(F.size("_base") > 0, blanked(F.col("_text"), F.array_sort("_base"))).otherwise(F.col("_text")))
    df = _found(df, "_text", "markov", CANDIDATE, r"[A-Za-z0-9+/_-]{12}")
    mixed = lambda m: m.rlike(MIXED)
    rank, kind = F.lit(KINDS.index("markov")).alias("rank"), F.lit("markov").alias("kind")
    span = lambda s, x: F.struct((s + x["from"]).alias("start"), (s + x["to"]).alias("end"), rank, kind, x["score"].alias("score"))
    part = lambda m, x: F.substring(m, x["from"] + 1, x["to"] - x["from"])
    random = lambda m: F.when(mixed(m), F.filter(stretches(m, model, least_ratio), lambda x: mixed(part(m, x)))).otherwise(F.array().cast(STRETCH))
    more = F.flatten(F.zip_with("_s", "_m", lambda s, m: F.transform(random(m), lambda x: span(s, x)))).cast(SPAN)
    df = df.withColumn("_more", F.when(F.size("_m") > 0, more).otherwise(F.array().cast(SPAN))).drop("_m", "_s")
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.array_sort(F.concat("_base", "_more")).alias(out))


def _replaced(text: Column, spans: Column, put) -> Column:
    """The text with the part of each span, from the last one's end on, replaced by put(start, end, whether it begins there)."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done"))
    cut = lambda s, x: F.substring(text, (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
    return F.aggregate(
        spans,
        start,
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.concat(s["done"], cut(s, x), put(F.greatest(s["at"], x["start"]), F.greatest(s["at"], x["end"]), x["start"] >= s["at"])).alias("done"),
        ),
        lambda s: F.concat(s["done"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by MASK."""
    return _replaced(text, spans, lambda start, end, begins: F.when(begins, F.lit(MASK)).otherwise(F.lit("")))


def blanked(text: Column, spans: Column) -> Column:
    """The text, as long as before, with spaces in place of the spans."""
    return _replaced(text, spans, lambda start, end, begins: F.repeat(F.lit(" "), (end - start).cast("int")))


def redact(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """The same rows and columns with every span of the text masked; a null text stays null."""
    (spans,) = fresh(docs.columns, "spans")
    found = scan(docs, model, text, spans)
    new = F.when(F.size(spans) > 0, masked(F.col(f"`{text}`"), F.col(spans))).otherwise(F.col(f"`{text}`"))
    return found.withColumn(text, new).select(*[F.col(f"`{c}`") for c in docs.columns])


def digests(found: DataFrame, spans: str = "secrets") -> list[Column]:
    """Columns n_assign, n_access, n_hex, base_sha256 and spans of a scanned table."""
    told = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter(spans, lambda x: x["rank"] < len(BASE))
    count = lambda rank: F.size(F.filter(spans, lambda x: x["rank"] == rank)).cast("bigint")
    n = [count(rank).alias(f"n_{kind}") for rank, kind in enumerate(BASE)]
    return [
        *n,
        F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, told), ",").alias("spans"),
    ]


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(labelled_samples(spark)))
    return found.select("doc_id", *digests(found))
