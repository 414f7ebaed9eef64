"""Personal data: exact kinds by rule, and further spans by boosted trees.

The base kinds are regular expressions with checks. Beside them, generators propose every number of seven
digits or more and every obfuscated address; boosted trees score them by format and context, and a
threshold calibrated on rows the trees have not seen selects what is redacted too. The trees learn from
the corpus itself: proposals that a base rule confirms are examples of personal data, with the marks hidden
that the rule goes by. What no rule confirms is no example of the contrary where it looks like these: first
trees tell which of it does not, and the second ones learn from that. Numbers of a card's length whose check sum
fails are examples of the contrary in any case, in the fit and in the calibration, unless a word for phones stands before them.
All of it is DataFrame functions and Spark ML; no Python runs on the executors.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.ml.classification import GBTClassifier, GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.session import materialize

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Possessive quantifiers and the look-behinds change no match: a match begins where a
#: run of its first class begins or the last match ended. They keep the matcher linear and off the stack.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: The generators' patterns.
_NUMBER = r"(?<![0-9A-Za-z.+(])[+(]?[0-9](?:[ ()./-]{0,2}+[0-9])++"
_HIDDEN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({](?i:at)[\])}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({](?i:dot)[\])}]) ?[A-Za-z0-9-]++)++"

#: Digits of a proposed number at most.
MOST_DIGITS = 19
#: Characters of context before and after a span.
CONTEXT = 32
#: Precision that the calibrated threshold reaches on candidates held out of the fit.
PRECISION = 0.95
#: First trees' probability from which an unconfirmed candidate is no example. Of any numbers a tenth passes the
#: check sum; twice that is more than chance.
UNSURE = 0.2
#: Threshold at least, whatever the share of the confirmed.
LEAST = 0.5

_WORDS = {
    "says_phone": r"(?i)\b(?:tel|phone|call|fax|mobil\w*|cell)\b",
    "says_mail": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "says_card": r"(?i)\b(?:card|visa|credit|iban|account)\b",
    "says_id": r"(?i)\b(?:ssn|social|passport|id)\b",
    "says_other": r"(?i)\b(?:version|isbn|order|invoice|part|serial|no|page|year)\b",
}
FEATURES = (
    "chars digits check groups widest narrowest spaces dashes dots parens slashes hidden alone before_alpha after_alpha line_start".split()
    + list(_WORDS)
)
_SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(numbers: Column) -> Column:
    """What stands before each number, summed up; in blocks, so that the work stays near linear."""
    block = 256
    last = F.size(numbers) - 1
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(last / block).cast("int")), lambda b: F.slice(numbers, b * block + 1, F.lit(block))
    )

    def grow(first: Column, values: Column) -> Column:
        return F.aggregate(values, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def fill(bs: Column) -> Column:
        sums = F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return _let(
            grow(F.lit(0), sums),
            lambda firsts: F.flatten(F.transform(bs, lambda b, i: F.slice(grow(F.get(firsts, i), b), 1, F.size(b)))),
        )

    return _let(blocks, fill)


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: an array of (start, end, value, before, after), in code points."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("p"))

    def place(s: Column) -> Column:
        steps = F.transform(s["m"], lambda m, i: F.length(m) + F.length(F.get(s["p"], i)))
        return _let(
            _running(steps),
            lambda at: F.transform(
                s["m"],
                lambda m, i: _let(
                    F.get(at, i) + F.length(F.get(s["p"], i)),
                    lambda start: F.struct(
                        start.alias("start"),
                        (start + F.length(m)).alias("end"),
                        m.alias("value"),
                        F.right(F.get(s["p"], i), F.lit(CONTEXT)).alias("before"),
                        F.left(F.get(s["p"], i + 1), F.lit(CONTEXT)).alias("after"),
                    ),
                ),
            ),
        )

    empty = F.array().cast(f"array<{_SPAN}>")
    return _let(both, lambda s: F.when(F.size(s["m"]) > 0, place(s)).otherwise(empty))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(value: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(
        F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255)
    )


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits holds."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _is_card(value: Column) -> Column:
    return F.length(_digits(value)).between(12, 19) & luhn(_digits(value))


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def _where(possible: Column, spans: Column) -> Column:
    return F.when(possible, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def base_spans(text: Column) -> Column:
    """The base kinds: an array of (start, kind, end), sorted; ``kind`` is the place in ``KINDS``."""
    digit, at, plus = text.rlike("[0-9]"), text.contains("@"), text.contains("+")
    found = [
        _where(at, find(text, _EMAIL)),
        _where(digit, F.filter(find(text, _IP), lambda s: _is_ip(s["value"]))),
        _where(digit, F.filter(find(text, _CARD), lambda s: _is_card(s["value"]))),
        _where(plus, F.filter(find(text, _PHONE), lambda s: _is_phone(s["value"]))),
    ]
    return F.array_sort(reduce(F.concat, [_kind(spans, k) for k, spans in enumerate(found)]))


def _kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _part(spans: Column, part: bool) -> Column:
    names = ("start", "end", "value", "before", "after")
    return F.transform(spans, lambda s: F.struct(*[s[n].alias(n) for n in names], F.lit(part).alias("part")))


def _parts(run: Column) -> Column:
    """The spans from word to word of a run of numbers, without the whole; a word has a digit at least."""
    words = F.filter(find(run["value"], "[^ /]+"), lambda w: w["value"].rlike("[0-9]"))

    def span(first: Column, last: Column) -> Column:
        value = F.substring(run["value"], first["start"] + 1, last["end"] - first["start"])
        before = F.concat(run["before"], F.left(run["value"], first["start"]))
        after = F.concat(F.substring(run["value"], last["end"] + 1, F.lit(CONTEXT)), run["after"])
        return F.struct(
            (run["start"] + first["start"]).alias("start"),
            (run["start"] + last["end"]).alias("end"),
            value.alias("value"),
            F.right(before, F.lit(CONTEXT)).alias("before"),
            F.left(after, F.lit(CONTEXT)).alias("after"),
        )

    def spans(ws: Column) -> Column:
        each = F.transform(ws, lambda w, i: F.transform(F.slice(ws, i + 1, F.lit(MOST_DIGITS)), lambda last: span(w, last)))
        return F.filter(F.flatten(each), lambda s: _is_number(s["value"]) & (s["end"] - s["start"] < F.length(run["value"])))

    return _where(run["value"].rlike("[ /]"), _let(words, spans))


def _is_number(value: Column) -> Column:
    return F.length(_digits(value)).between(7, MOST_DIGITS)


def proposals(text: Column) -> Column:
    """All that may be personal data, overlaps allowed: an array of (start, end, value, before, after, part).

    Neighbouring numbers are proposed together and in parts. Plain addresses are among them as examples.
    """

    def numbers(runs: Column) -> Column:
        whole = F.filter(runs, lambda s: _is_number(s["value"]))
        return F.concat(_part(whole, False), _part(F.flatten(F.transform(runs, _parts)), True))

    return F.concat(
        _let(_where(text.rlike("[0-9]"), find(text, _NUMBER)), numbers),
        _part(_where(text.rlike(r"(?i)[\[({]at[\])}]"), find(text, _HIDDEN)), False),
        _part(_where(text.contains("@"), find(text, _EMAIL)), False),
    )


def _hidden(value: Column) -> Column:
    """The forms of a confirmed value without the marks that its rule goes by; others as they are."""
    address = [F.replace(value, F.lit("@"), F.lit(at)) for at in ("[at]", " [at] ")]
    address.append(F.replace(address[1], F.lit("."), F.lit(" [dot] ")))
    plain = F.substring(value, 2, F.length(value))
    forms = F.when(value.contains("@"), F.array(*address)).when(value.startswith("+"), F.array(value, plain, F.regexp_replace(value, r"^\+[0-9]{1,3}[ .-]+", "")))
    return F.array_distinct(forms.otherwise(F.array(value)))


def _features(c: Column) -> list[Column]:
    value, before, after = c["value"], c["before"], c["after"]
    sizes = F.transform(F.filter(F.split(value, "[^0-9]+"), lambda g: g != ""), F.length)
    count = lambda p: F.length(F.regexp_replace(value, f"[^{p}]", ""))
    columns = {
        "chars": F.length(value),
        "digits": count("0-9"),
        # a card's length: whether the check sum holds; 0 for others
        "check": F.when(count("0-9").between(12, 19), F.when(luhn(_digits(value)), 1).otherwise(-1)).otherwise(0),
        "groups": F.size(sizes),
        "widest": F.coalesce(F.array_max(sizes), F.lit(0)),
        "narrowest": F.coalesce(F.array_min(sizes), F.lit(0)),
        "spaces": count(" "),
        "dashes": count("-"),
        "dots": count("."),
        "parens": count("()"),
        "slashes": count("/"),
        "hidden": value.rlike("[A-Za-z]"),
        "alone": before.rlike(r"(?:^|\s)\z") & after.rlike(r"^(?:$|[\s.,;])"),
        "before_alpha": before.rlike(r"[A-Za-z]\z"),
        "after_alpha": after.rlike("^[A-Za-z]"),
        "line_start": before.rlike(r"(?:^|\n)\z"),
    } | {name: before.rlike(words) for name, words in _WORDS.items()}
    return [columns[name].cast("double").alias(name) for name in FEATURES]


def _with_probability(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    out = model.setFeaturesCol("features").transform(ready)
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit(candidates: DataFrame) -> tuple[GBTClassificationModel, float] | None:
    """Trees and threshold from labelled candidates (``FEATURES``, ``label``, ``draw``).

    All rows count: equal ones are one row with their number as its weight, so what the trees pass over again and again are
    the different formats. One row in five is held out for the
    threshold: the least probability, from ``LEAST``, from which on they reach ``PRECISION``. Unconfirmed rows
    that first trees find like confirmed ones are left out of both, but not those that ``_refuted`` names. None, with a warning
    that says why, if a class is missing or no threshold reaches it.
    """
    held = (F.pmod("draw", F.lit(5)) == 0).alias("held")
    counted = candidates.groupBy(*FEATURES, "label", held).agg(F.count("*").cast("double").alias("weight"))
    counted = materialize(counted)
    # Spark ML looks for splits in a sample once there are more rows than the square of the bins
    bins = min(46_340, max(32, math.isqrt(counted.count()) + 1))
    trees = GBTClassifier(maxDepth=3, maxIter=20, stepSize=0.2, seed=7, maxMemoryInMB=64, maxBins=bins, weightCol="weight")

    def learned(rows: DataFrame) -> GBTClassificationModel | None:
        learn = rows.where("not held")
        if learn.select("label").distinct().count() < 2:
            return None
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(learn)
        return trees.fit(ready.select("features", "label", "weight"))

    first = learned(counted)
    if first is None:
        return _nothing("the proposals do not have both confirmed and unconfirmed ones")
    sure = _with_probability(first, counted).where((F.col("label") == 1) | (F.col("p") < UNSURE) | _refuted()).drop("p")
    sure = materialize(sure)
    model = learned(sure)
    if model is None:
        return _nothing("all unconfirmed proposals look like confirmed ones")
    scored = _with_probability(model, sure.where("held")).groupBy(F.floor(F.col("p") * 100).alias("bin"))
    rows = scored.agg(F.sum(F.col("label") * F.col("weight")).alias("right"), F.sum("weight").alias("all")).collect()  # 101 at most
    threshold, right, every = None, 0.0, 0
    for r in sorted(rows, key=lambda r: -r["bin"]):
        right, every = right + r["right"], every + r["all"]
        if right >= PRECISION * every and r["bin"] >= 100 * LEAST:
            threshold = r["bin"] / 100
    return (model, threshold) if threshold is not None else _nothing(f"no threshold reaches a precision of {PRECISION}")


def _refuted() -> Column:
    """Candidates that a rule speaks against, with no word before them that speaks for a phone."""
    return (F.col("label") == 0) & (F.col("check") == -1) & (F.col("says_phone") == 0)


def _nothing(why: str) -> None:
    warnings.warn(f"only base spans are found: {why}", stacklevel=3)


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document row without its text, with ``base``, ``row_key`` and ``proposed`` (written)."""
    kept = [c for c in docs.columns if c not in (text, "base", "added", "proposed", "row_key")]
    key = F.struct(F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns))
    body = F.coalesce(F.col(text), F.lit(""))
    return materialize(docs.select(*kept, key.alias("row_key"), base_spans(body).alias("base"), proposals(body).alias("proposed")))


def candidates(scanned: DataFrame) -> DataFrame:
    """A row per proposal, with features; ``label`` 1 where a base span overlaps it.

    Confirmed ones come in the forms that hide how; their parts are left out.
    """
    rows = scanned.where(F.size("proposed") > 0).select("row_key", "base", F.explode("proposed").alias("c"))
    known = F.exists("base", lambda b: _overlap(b, F.col("c"))).cast("double")
    rows = rows.withColumn("label", known).where("label = 0 or not c.part")
    forms = F.when(F.col("label") == 1, _hidden(F.col("c.value"))).otherwise(F.array("c.value"))
    rows = rows.withColumn("value", F.explode(forms)).withColumn("c", F.col("c").withField("value", F.col("value")))
    draw = F.xxhash64("row_key", "c.start")
    return rows.select("row_key", "c.start", "c.end", *_features(F.col("c")), "label", draw.alias("draw"))


def _best_apart(spans: Column) -> Column:
    """Of (start, end, p) in the order of their starts those that overlap no better one beside them."""
    better = lambda a, b: (a["p"] > b["p"]) | ((a["p"] == b["p"]) & (a["end"] - a["start"] > b["end"] - b["start"]))

    def add(kept: Column, s: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        swapped = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(s))
        apart = (F.size(kept) == 0) | (s["start"] >= last["end"])
        return F.when(apart, F.concat(kept, F.array(s))).when(better(s, last), swapped).otherwise(kept)

    empty = F.array().cast("array<struct<start:int,end:int,p:double>>")
    kept = F.aggregate(spans, empty, add)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document row without its text, with ``base`` (start, kind, end) and ``added`` (start, end).

    Positions count code points, the end is exclusive. Added spans overlap no base span nor each other.
    Null and empty texts have no spans. Equal rows stay as many rows as they were, other columns are kept,
    columns of the given names are replaced.
    """
    scanned = scan(docs, text)
    rows = candidates(scanned)
    fitted = fit(rows)
    none = F.array().cast("array<struct<start:int,end:int>>")
    if fitted is None:
        return scanned.withColumn("added", none).drop("proposed")
    model, threshold = fitted
    chosen = _with_probability(model, rows.where("label = 0")).where(F.col("p") >= threshold)
    chosen = chosen.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("start", "end", "p"))).alias("added"))
    chosen = chosen.withColumn("added", _best_apart(F.col("added")))
    return scanned.drop("proposed").join(chosen, "row_key", "left").withColumn("added", F.coalesce("added", none))


def redact(docs: DataFrame, text: str = "text", mask: str = "*") -> DataFrame:
    """``docs`` with every character of a span replaced by ``mask``, one character; documents without spans as they are."""
    if len(mask) != 1:
        raise ValueError("mask has to be one character, or positions behind it would move")
    key = F.struct(F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns))
    found = find_spans(docs, text)
    ends = F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), F.col("added"))
    found = found.select(F.col("row_key").alias("_key"), F.array_sort(ends).alias("_spans")).where(F.size("_spans") > 0).distinct()
    joined = docs.withColumn("_key", key).join(materialize(found), "_key", "left")
    masked = F.aggregate(
        "_spans",
        F.col(text),
        lambda t, s: F.overlay(t, F.repeat(F.lit(mask), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]),
    )
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(masked)).select(docs.columns)
