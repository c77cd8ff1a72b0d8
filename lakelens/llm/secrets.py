"""Secret scanning on SQL functions only: known shapes, then a randomness battery on other strings.

Known shapes (kinds assign, access, hex) are found by pattern. Every other run of 20 or more
characters of the encodings' alphabets, with a digit and a letter, is a candidate. Its encoding is
inferred (hex, base32, base36 for other letters and digits of one case, base62, base64) and three tests of
uniform randomness are made in that alphabet: Pearson's chi-squared over symbols, the Wald-Wolfowitz
runs test about the alphabet's middle and the lag-one serial correlation; Fisher's method joins their
p-values. A candidate whose joined p-value is below `reject` isn't random and isn't counted further.
A discovery needs evidence against the opposite hypothesis, that the string is ordinary writing: the
likelihood of the string as writing over that as uniform symbols of its encoding (under writing,
such a ratio is below p with a chance of at most p). Writing is a chain of lower case, upper case,
digits and signs, with English letter frequencies. That ratio, divided by the battery's joined
p-value, is still a p-value of writing, and asks for more the less uniform a string is. Weighted
Benjamini-Hochberg control over it, with weights in proportion to length, picks the discoveries; the
family of hypotheses is the candidates of one text.

Work is linear in the text and in the number of its matches: places are summed in runs of RUN, and
strings that overlap a known shape are told by a mark put over that shape.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: As 'AKIA[A-Z0-9]+' and '[0-9a-f]+' of such lengths: a run too short contains no long enough one.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RANDOM = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: A character that no text has (texts that do get MARK's neighbour for it) covers what is known already.
MARK, NO_MARK = "\uffff", "\ufffe"
RANDOM_OR_MARK = RANDOM.replace("_-]", "_" + MARK + "-]")
RUN = 64
KINDS = ("assign", "access", "hex", "random")
_NONE = "array<struct<kind:int,start:int,end:int,word:string>>"
#: Symbols of each encoding.
ALPHABETS = {
    "hex": "0123456789abcdef", "base32": "abcdefghijklmnopqrstuvwxyz234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Ordinary writing, set by hand: percent of English letters a to z, and the chances that a text starts
#: with, and that from one kind of character to the next it goes to, upper case, lower case, digit, sign.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
STARTS = (0.30, 0.50, 0.15, 0.05)
MOVES = ((0.55, 0.35, 0.05, 0.05), (0.03, 0.84, 0.05, 0.08), (0.10, 0.10, 0.60, 0.20), (0.25, 0.55, 0.17, 0.03))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost, non-overlapping matches: gap before, word, and the inner group."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("word"), inner.alias("inner"))
    return F.when(text.rlike(pattern), parts).otherwise(F.array().cast("array<struct<gap:string,word:string,inner:string>>"))


def _with_spans(df: DataFrame, name: str, kind: int, keep=None) -> DataFrame:
    """df whose column name, from _matches, became spans with code-point places.

    Places are running sums: within runs of RUN matches first, then over the runs, so that no array
    is copied once a match.
    """
    n = F.size(name)
    df = df.withColumn(name, F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda b: F.slice(name, b * RUN + 1, F.lit(RUN)))).otherwise(F.array().cast("array<array<struct<gap:string,word:string,inner:string>>>")))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["word"])
        one = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["word"].alias("word")))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(keep(x["inner"]), one).otherwise(F.array().cast(_NONE)) if keep else one).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out"))
    df = df.withColumn(name, F.transform(name, lambda run: F.aggregate(run, zero, step)))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    before = F.aggregate(name, none, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
    moved = lambda r, o: F.transform(r["out"], lambda x: F.struct(x["kind"].alias("kind"), (x["start"] + o).alias("start"), (x["end"] + o).alias("end"), x["word"].alias("word")))
    return df.withColumn(name, F.flatten(F.zip_with(name, before, moved)))


def _covered(text: Column, pattern: str, group: int = 0, keep=None) -> Column:
    """text with MARK in place of each character of the matches."""
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else words
    marks = F.zip_with(words, inner, lambda w, i: F.when(keep(i) if keep else F.lit(True), F.repeat(F.lit(MARK), F.length(w))).otherwise(w))
    whole = F.array_join(F.zip_with(F.split(text, pattern, -1), F.concat(marks, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(text.rlike(pattern), whole).otherwise(text)


def _tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, by a logistic curve that is right to 0.0002."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _alphabet(kind: Column) -> Column:
    return F.when(kind == "hex", ALPHABETS["hex"]).when(kind == "base32", ALPHABETS["base32"]).when(kind == "base36", ALPHABETS["base36"]).when(kind == "base62", ALPHABETS["base62"]).otherwise(ALPHABETS["base64"])


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + f(v))


def _writing(chars: Column) -> Column:
    """The logarithm of a string's likelihood as ordinary writing, from its characters."""
    logs = lambda values: F.array(*[F.lit(math.log(v)) for v in values])
    share = [x / sum(LETTERS) for x in LETTERS]
    emitted, moved, started = logs([*share, *share, *[0.1] * 10, *[0.5] * 2]), logs([x for row in MOVES for x in row]), logs(STARTS)
    kind = lambda a: F.when(a <= 26, 0).when(a <= 52, 1).when(a <= 62, 2).otherwise(3)

    def step(acc, ch):
        a = F.instr(F.lit(ALPHABETS["base64"]), ch)
        move = F.when(acc["kind"] < 0, F.element_at(started, kind(a) + 1)).otherwise(F.element_at(moved, F.greatest(acc["kind"], F.lit(0)) * 4 + kind(a) + 1))
        return F.struct(kind(a).alias("kind"), (acc["log"] + move + F.element_at(emitted, a)).alias("log"))

    zero = F.struct(F.lit(-1).alias("kind"), F.lit(0.0).alias("log"))
    return F.aggregate(chars, zero, step, lambda acc: acc["log"])


def battery(df: DataFrame, column: str, carried: tuple = ("start", "end", "word")) -> DataFrame:
    """df whose column, an array of structs with a word, got encoding, statistics and p-values.

    chi2 is Pearson's statistic over the encoding's symbols, runs the number of runs above and below
    the alphabet's middle, serial the lag-one correlation; uniform is the joined p-value of the three
    tests of randomness, writing the p-value of the hypothesis that the word is ordinary writing.
    """

    def grown(frame: DataFrame, kept: tuple, **fields) -> DataFrame:
        make = lambda x: F.struct(*[x[k].alias(k) for k in kept], *[f(x).cast("double").alias(n) if n not in ("s", "encoding", "alphabet", "chars", "folded", "v") else f(x).alias(n) for n, f in fields.items()])
        return frame.withColumn(column, F.transform(column, make))

    bare = lambda x: F.translate(F.regexp_replace(x["word"], "=+$", ""), "-_", "+/")
    kind = lambda x: F.when(x["s"].rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(x["s"].rlike("^(?:[a-z2-7]+|[A-Z2-7]+)$"), "base32").when(x["s"].rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$"), "base36").when(x["s"].rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")
    df = grown(df, carried, s=bare)
    df = grown(df, (*carried, "s"), encoding=kind)
    df = grown(
        df, (*carried, "encoding"), alphabet=lambda x: _alphabet(x["encoding"]), chars=lambda x: F.regexp_extract_all(x["s"], F.lit("."), F.lit(0)),
        n=lambda x: F.length(x["s"]), k=lambda x: F.length(_alphabet(x["encoding"])), exact=lambda x: x["encoding"].isin("base62", "base64"),
        folded=lambda x: F.when(x["encoding"].isin("base62", "base64"), x["s"]).otherwise(F.lower(x["s"])),
    )
    at = lambda x, ch: F.instr(x["alphabet"], F.when(x["exact"] > 0, ch).otherwise(F.lower(ch))).cast("double") - 1
    often = lambda s, ch: (F.length(s) - F.length(F.replace(s, ch, F.lit("")))).cast("double")
    df = grown(
        df, (*carried, "encoding", "n", "k"), v=lambda x: F.transform(x["chars"], lambda ch: at(x, ch)), written=lambda x: _writing(x["chars"]),
        squares=lambda x: _sum(F.regexp_extract_all(x["alphabet"], F.lit("."), F.lit(0)), lambda ch: F.pow(often(x["folded"], ch), F.lit(2.0))),
    )
    df = grown(
        df, (*carried, "encoding", "v", "n", "k", "written", "squares"),
        high=lambda x: F.size(F.filter(x["v"], lambda a: a >= x["k"] / 2)), mean=lambda x: _sum(x["v"], lambda a: a) / x["n"],
    )
    pairs = lambda x, f: F.zip_with(F.slice(x["v"], F.lit(1), (x["n"] - 1).cast("int")), F.slice(x["v"], F.lit(2), (x["n"] - 1).cast("int")), f)
    df = grown(
        df, (*carried, "encoding", "n", "k", "written", "squares", "high"),
        runs=lambda x: 1 + _sum(pairs(x, lambda a, b: ((a >= x["k"] / 2) != (b >= x["k"] / 2)).cast("double")), lambda c: c),
        cov=lambda x: _sum(pairs(x, lambda a, b: (a - x["mean"]) * (b - x["mean"])), lambda c: c),
        var=lambda x: _sum(x["v"], lambda a: (a - x["mean"]) * (a - x["mean"])),
    )
    two = lambda x: 2 * x["high"] * (x["n"] - x["high"])
    spread = lambda x: F.greatest(F.lit(1e-9), two(x) * (two(x) - x["n"]) / (x["n"] * x["n"] * (x["n"] - 1)))
    tests = (*carried, "encoding", "chi2", "runs", "serial", "writing")
    df = grown(
        df, (*carried, "encoding", "n", "k", "high", "runs"),
        writing=lambda x: F.exp(F.least(F.lit(0.0), x["written"] + x["n"] * F.log(x["k"]))),
        chi2=lambda x: x["k"] / x["n"] * x["squares"] - x["n"], serial=lambda x: F.when(x["var"] > 0, x["cov"] / F.greatest(x["var"], F.lit(1e-9))),
    )
    df = grown(
        df, tests,
        zu=lambda x: (x["chi2"] - (x["k"] - 1)) / F.sqrt(2 * (x["k"] - 1) * (x["n"] - 1) / x["n"]),
        zr=lambda x: F.abs(x["runs"] - two(x) / x["n"] - 1) / F.sqrt(spread(x)),
        zs=lambda x: F.coalesce(F.abs(x["serial"] + 1 / x["n"]) * F.sqrt(x["n"]), F.lit(8.0)),
    )
    two_sided = lambda z: F.least(F.lit(1.0), 2 * _tail(z))
    df = grown(df, tests, half=lambda x: -(F.log(_tail(x["zu"])) + F.log(two_sided(x["zr"])) + F.log(two_sided(x["zs"]))))
    return grown(df, tests, uniform=lambda x: F.exp(-x["half"]) * (1 + x["half"] + x["half"] * x["half"] / 2))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.001, rate: float = 0.01) -> DataFrame:
    """doc_id and spans: array<struct<kind, start, end, word>> by start, then kind; one row per input row.

    Places are code points, ends exclusive; kind is a name of KINDS. Spans of one kind don't overlap;
    spans of kind random overlap no other span. Null and empty texts have no spans; long texts and
    long strings are read whole, in time linear in their length. Ids are carried as they are, null or
    repeated, and repeated rows are read each; other columns are not read. Work on a text is on that
    row alone, so nothing is shuffled. An empty table gives an empty one.
    """
    text, long_enough = F.coalesce(F.col(text_col).cast("string"), F.lit("")), lambda w: F.length(w) >= 6
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    df = df.withColumn("u", F.when(F.col("t").contains(MARK), F.translate("t", MARK, NO_MARK)).otherwise(F.col("t")))
    df = df.withColumn("u", _covered(F.col("u"), ASSIGN, 2, long_enough))
    df = df.withColumn("u", _covered(F.col("u"), ACCESS))
    df = df.withColumn("u", _covered(F.col("u"), HEX))
    t = F.col("t")
    df = df.select("doc_id", _matches(t, ASSIGN, 2).alias("b0"), _matches(t, ACCESS).alias("b1"), _matches(t, HEX).alias("b2"), _matches(F.col("u"), RANDOM_OR_MARK).alias("c"))
    df = _with_spans(df, "b0", 0, long_enough)
    for name, kind in (("b1", 1), ("b2", 2), ("c", 3)):
        df = _with_spans(df, name, kind)
    df = df.withColumn("c", F.filter("c", lambda x: ~x["word"].contains(MARK) & x["word"].rlike("[0-9]") & x["word"].rlike("[A-Za-z]")))
    df = df.select("doc_id", F.concat("b0", "b1", "b2").alias("base"), "c")
    # What fails the randomness tests can't be found, and isn't among the hypotheses.
    df = battery(df, "c").withColumn("c", F.filter("c", lambda x: x["uniform"] >= reject))
    df = df.withColumn("m", F.size("c"))
    df = df.withColumn("average", _sum(F.transform("c", lambda x: F.length(x["word"]).cast("double")), lambda n: n) / F.greatest(F.col("m"), F.lit(1)))
    # Benjamini-Hochberg over p / weight, smallest first.
    p = lambda x: x["writing"] / x["uniform"] * F.col("average") / F.length(x["word"])
    scored = F.transform("c", lambda x: F.struct(p(x).alias("q"), x["start"].alias("start"), x["end"].alias("end"), x["word"].alias("word")))
    df = df.withColumn("c", F.array_sort(scored))
    last = F.aggregate(F.sequence(F.lit(1), F.size("c")), F.lit(0), lambda acc, r: F.when(F.col("c")[r - 1]["q"] <= r * rate / F.col("m"), r).otherwise(acc))
    df = df.withColumn("last", F.when(F.size("c") > 0, last).otherwise(F.lit(0)))
    more = F.transform(F.slice("c", F.lit(1), F.col("last")), lambda x: F.struct(F.lit(3).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["word"].alias("word")))
    ordered = F.array_sort(F.transform(F.concat("base", more), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["word"].alias("word"))))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return df.select("doc_id", F.transform(ordered, lambda x: F.struct(name(x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["word"].alias("word"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the spans as text, and the SHA-256 of those of known shape; from find_secrets."""
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    known = F.filter("spans", lambda x: x["kind"] != KINDS[3])
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(written(known).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )
