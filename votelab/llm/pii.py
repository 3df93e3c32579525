r"""Personal data by candidate gradient boosting, with DataFrame functions only.

High-recall generators propose spans. Those of the base kinds (e-mail, IPv4 address, card, phone) pass by the rules of
``valid``; the others (disguised addresses, plain phone numbers, cards with other separators, credentials, social
security numbers) overlap them and each other, and boosted trees over format and context decide. The trees are fitted
on the driver to a bounded sample and walked by array functions; each generator's threshold is the least one
that reaches ``PRECISION`` on the sample's held-out quarter.

Labels come from the base rules: candidates of base generators are 1 if valid, else 0; the others learn from rewrites
of the sample's own spans, in their own context: an address with its signs spelt out, a number without its plus, a
card with dots (1) or with a wrong last digit (0), a credential without its name (1) or with a value of letters only
(0), address digits with hyphens (0), and so on (``rewrites``).

Positions: ``split`` at a generator's pattern gives the text between its matches, so a running sum of lengths gives
every match's place in code points. Patterns can't backtrack over more than a run of separators and never start in
the middle of a run, so their time is linear in the text; the base ones match exactly what the plain patterns match.

Defined results: a null text reads as empty and has no spans; base spans of different kinds may overlap and all stay; an
added span that overlaps a base span, or an added one that starts before it (ties: the kind listed first, then the
longer), goes; equal starts are listed by kind. Rows count each for itself, also with a null or repeated id; an empty
table gives no rows; with no labelled candidate, or of one label only, nothing is added. Very long texts are whole:
only a text's own candidates meet in one group. Other input columns pass through (the text if asked for); an output
column takes the place of one of its name.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh
from .rules import Trees, fit

SAMPLE_TEXTS, SAMPLE_ROWS = 20_000, 6_000
PRECISION = 0.95
CONTEXT = 24
KINDS = ["email", "ip", "card", "phone", "secret", "ssn"]

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_KEYISH = "[A-Za-z0-9_+/-]"
_NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
_AT, _DOT = r"(?: ?[(\[{] ?(?:at|AT|@) ?[)\]}] ?| (?:at|AT) )", r"(?: ?[(\[{] ?(?:dot|DOT|\.) ?[)\]}] ?| (?:dot|DOT) )"


class Generator(NamedTuple):
    """``needs``: tests of which each match passes one, cheaper than the pattern: single characters or words that the
    text must hold, or ``[0-9]``."""
    kind: str
    pattern: str
    base: bool
    needs: tuple[str, ...]


_DIGIT = ("[0-9]",)
GENERATORS = {
    "email": Generator("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", True, ("@",)),
    "ip": Generator("ip", r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, _DIGIT),
    "card": Generator("card", r"[0-9](?:[\x20-]?[0-9])++", True, _DIGIT),
    "phone": Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, ("+",)),
    "email_words": Generator("email", rf"(?<!{_LOCAL}){_LOCAL}++{_AT}{_LABEL}++(?:{_DOT}{_LABEL}++)++", False,
                             ("dot", "DOT", "(.", "( .", "[.", "[ .", "{.", "{ .")),
    "phone_plain": Generator("phone", r"(?=[(0-9])(?<![0-9A-Za-z+.(-])(?<!\+[0-9] )(?<!\+[0-9]{2} )(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])"
                             r"[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])", False, _DIGIT),
    "card_other": Generator("card", r"(?=[0-9])(?<![0-9._/])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9]|[._/][0-9])", False, _DIGIT),
    "secret": Generator("secret", rf"(?<![A-Za-z0-9]){_NAME}[\"']? ?[=:] ?[\"']?[^\s\"',;]{{6,}}+[\"']?"
                        rf"|(?<!{_KEYISH})(?={_KEYISH}{{12}})(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z]){_KEYISH}++", False, ("=", ":", *_DIGIT)),
    "ssn": Generator("ssn", r"(?=[0-9])(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", False, _DIGIT),
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_NO = {g: i for i, g in enumerate(GENERATORS)}


def candidates(df: DataFrame, text: str, keep: list[str], once: list[str] | None = None) -> DataFrame:
    """A row for each match of each generator: the columns ``keep``, the generator ``gen``, the match's number ``at``,
    its text ``m``, the code points before it since the last one (``gap``), and the text around (``before``,
    ``after``). A text without matches has one row, of null ``gen``. The columns ``once`` are null but on a text's
    first row."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = []
    for name, g in GENERATORS.items():
        rest = F.split(t, g.pattern, -1)
        zipped = F.arrays_zip(F.regexp_extract_all(t, F.lit(g.pattern), F.lit(0)).alias("m"), rest.alias("p"),
                              F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0))).alias("q"))
        rows = F.transform(F.filter(zipped, lambda z: z["m"].isNotNull()), lambda z, i: F.struct(
            F.lit(_NO[name]).alias("gen"), i.alias("at"), z["m"].alias("m"), F.char_length(z["p"]).cast("long").alias("gap"),
            F.right(z["p"], F.lit(CONTEXT)).alias("before"), F.left(z["q"], F.lit(CONTEXT)).alias("after")))
        able = [F.rlike(t, F.lit(n)) if n in _DIGIT else F.contains(t, F.lit(n)) for n in g.needs]
        found.append(F.when(reduce(Column.__or__, able) & F.rlike(t, F.lit(g.pattern)), rows))
    none = F.array().cast("array<struct<gen:int,at:int,m:string,gap:bigint,before:string,after:string>>")
    rows = df.select(*keep, *(once or []), F.posexplode_outer(F.concat(*[F.coalesce(x, none) for x in found])).alias("no", "c"))
    first = F.coalesce("no", F.lit(0)) == 0
    return rows.select(*keep, *[F.when(first, F.col(c)).alias(c) for c in once or []], "c.*")


def _count(c: Column, chars: str) -> Column:
    return F.char_length(F.regexp_replace(c, f"[^{chars}]", ""))


def _luhn(digits: Column) -> Column:
    """The check digit is right, of 14 to 19 digits."""
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)).cast("array<int>"),
                       lambda x, i: F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0)))
    return F.when(F.char_length(digits).between(14, 19), F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)


def valid(gen: Column, m: Column) -> Column:
    """Whether a base generator's match is one of its kind; false for the other generators."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (F.when(gen == _NO["email"], True).when(gen == _NO["ip"], F.rlike(m, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")))
            .when(gen == _NO["card"], _luhn(digits)).when(gen == _NO["phone"], F.char_length(digits).between(10, 15)).otherwise(False))


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def features() -> dict[str, Column]:
    """Format and context features of a candidate, from the columns of ``candidates``."""
    return {
        "f_gen": F.col("gen").cast("double"),
        "f_len": F.char_length("m").cast("double"),
        "f_digits": _count(F.col("m"), "0-9").cast("double"),
        "f_letters": _count(F.col("m"), "A-Za-z").cast("double"),
        "f_upper": _count(F.col("m"), "A-Z").cast("double"),
        "f_groups": F.size(F.regexp_extract_all(F.col("m"), F.lit("[0-9]+"), F.lit(0))).cast("double"),
        "f_changes": F.size(F.regexp_extract_all(F.col("m"), F.lit("[0-9]+|[A-Za-z]+"), F.lit(0))).cast("double"),
        "f_luhn": _flag(_luhn(F.regexp_replace("m", "[^0-9]", ""))),
        "f_octets": _flag(F.rlike("m", F.lit(rf"^{_OCTET}(?:[.-]{_OCTET}){{3}}$"))),
        "f_plus": _flag(F.startswith("m", F.lit("+"))),
        "f_paren": _flag(F.contains("m", F.lit("("))),
        "f_at": _flag(F.rlike("m", F.lit("@|(?i: at |[(\\[{] ?at ?[)\\]}])"))),
        "f_named": _flag(F.rlike("m", F.lit(f"^{_NAME}"))),
        "f_issued": _flag(F.rlike("m", F.lit("^(?:AKIA|ASIA|ghp_|gho_|sk-|pk-|xox)"))),
        "f_hex": _flag(F.rlike("m", F.lit("^[0-9a-f]+$|[=:] ?[\"']?[0-9a-f]+[\"']?$"))),
        "f_zero_group": _flag(F.rlike("m", F.lit("(?:^|[^0-9])0+(?:[^0-9]|$)"))),
        "f_distinct": F.size(F.array_distinct(F.split(F.left(F.col("m"), F.lit(64)), ""))).cast("double"),
        "f_joined": _flag(F.rlike("before", F.lit("[A-Za-z0-9]$")) | F.rlike("after", F.lit("^[A-Za-z0-9]"))),
        "f_word_before": _flag(F.rlike("before", F.lit(r"(?i)(?:mail|phone|call|tel|fax|card|visa|key|login|user|ssn|server|host)\W{0,3}\w{0,4}\W{0,3}$"))),
        "f_version": _flag(F.rlike("before", F.lit(r"(?i)(?:version|section|chapter|v\.?|no\.?|page)\s?$"))),
    }


_VALUE = r"^[A-Za-z_-]+[\"']? ?[=:] ?[\"']?|[\"']$"
_FOURS = r"([0-9]{4})[ -]?([0-9]{4})[ -]?([0-9]{4})[ -]?([0-9]+)"


def rewrites() -> list[tuple[str, str, Column, int]]:
    """``(generator of the source span, the generator it trains, its rewritten text, label)``, for valid and named source
    spans."""
    last = F.expr("concat(substring(m, 1, char_length(m) - 1), cast((cast(right(m, 1) AS int) + 1) % 10 AS string))")
    ten = F.right(F.regexp_replace("m", "[^0-9]", ""), F.lit(10))
    return [
        ("email", "email_words", F.replace(F.replace("m", F.lit("@"), F.lit(" (at) ")), F.lit("."), F.lit(" (dot) ")), 1),
        ("email", "email_words", F.replace(F.replace("m", F.lit("@"), F.lit(" at ")), F.lit("."), F.lit(" dot ")), 1),
        ("phone", "phone_plain", F.regexp_replace("m", r"^\+[0-9]{1,3}[ .-]?", ""), 1),
        ("phone", "phone_plain", F.regexp_replace(ten, "^(...)(...)(....)$", "$1-$2-$3"), 1),
        ("phone", "ssn", F.regexp_replace(F.right(ten, F.lit(9)), "^(...)(..)(....)$", "$1-$2-$3"), 1),
        ("phone", "ssn", F.regexp_replace(F.right(ten, F.lit(9)), "^(...)(..)(....)$", "000-$2-$3"), 0),
        ("ip", "phone_plain", F.replace("m", F.lit("."), F.lit("-")), 0),
        ("card", "card_other", F.regexp_replace("m", _FOURS, "$1.$2.$3.$4"), 1),
        ("card", "card_other", F.regexp_replace(last, _FOURS, "$1.$2.$3.$4"), 0),
        ("card", "card", last, 0),
        ("card", "phone_plain", F.regexp_replace("m", _FOURS, "$1 $2 $3"), 0),
        ("secret", "secret", F.regexp_replace("m", _VALUE, ""), 1),
        ("secret", "secret", F.translate("m", "0123456789", "ghijklmnop"), 0),
        ("secret", "secret", F.concat(F.regexp_extract("before", "([A-Za-z]{3,})[^A-Za-z]*$", 1), F.lit("-2024-"), F.regexp_extract("after", "([A-Za-z]{3,})", 1)), 0),
    ]


class Model(NamedTuple):
    trees: Trees
    limits: dict[int, float]    # threshold by number of a generator that isn't a base one


def labelled(found: DataFrame) -> DataFrame:
    """The candidates that carry a label ``y``, and the rewrites that they train the other generators with."""
    base = F.col("gen") <= max(_NO[g] for g, x in GENERATORS.items() if x.base)
    named = (F.col("gen") == _NO["secret"]) & F.rlike("m", F.lit(f"^{_NAME}.*[0-9].*|^AKIA"))
    rows = found.where("gen is not null").select("gen", "m", "before", "after").withColumn("ok", valid(F.col("gen"), F.col("m")) | named)
    made = [F.when(F.col("gen") == _NO[source], F.struct(F.lit(_NO[to]).alias("gen"), m.alias("m"), F.lit(y).alias("y"))) for source, to, m, y in rewrites()]
    same = F.when(base | named, F.struct("gen", "m", F.col("ok").cast("int").alias("y")))
    each = F.array(same, *[F.when(F.col("ok"), x) for x in made])
    return (rows.select("before", "after", F.explode(F.array_compact(each)).alias("e")).select("e.*", "before", "after")
            .where(F.char_length("m") >= 6).distinct())


def train(df: DataFrame, text: str = "text", sample_texts: int = SAMPLE_TEXTS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trees and thresholds from the labelled candidates of about ``sample_texts`` texts, drawn by a hash of the text;
    at most ``sample_rows`` of them, drawn by a hash as well, reach the driver."""
    texts = df.select(F.col(text).alias("t")).where("t is not null")
    share = int((1 << 30) * min(1.0, sample_texts / max(1, texts.count())))
    drawn = texts.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < share)
    rows = labelled(candidates(drawn, "t", [])).withColumn("h", F.xxhash64("m", "before", "after", "gen", "y"))
    rows = rows.orderBy("h", "m", "gen", "y").limit(sample_rows).select("h", "y", "gen", *[c.alias(f) for f, c in features().items()]).collect()
    names = list(features())
    x = np.array([[r[f] for f in names] for r in rows], float).reshape(-1, len(names))
    y, gen = np.array([r["y"] for r in rows], float), np.array([r["gen"] for r in rows], int)
    held = np.array([r["h"] % 4 == 0 for r in rows], bool)
    never = {n: float("inf") for g, n in _NO.items() if not GENERATORS[g].base}
    if len(np.unique(y[~held])) < 2:
        return Model(fit(np.zeros((0, len(names))), np.zeros(0), constraints=[0] * len(names)), never)
    trees = fit(x[~held], y[~held], trees=40, depth=4, constraints=[0] * len(names))
    score = trees.scores(x[held])
    return Model(trees, {n: _limit(score[gen[held] == n], y[held][gen[held] == n]) if (gen == n).any() else float("inf") for n in never})


def _limit(score: np.ndarray, y: np.ndarray) -> float:
    """The least threshold, 0.5 or more, with at least ``PRECISION`` of labels 1 among the scores from it on: half way
    between the last score that is let through and the next one."""
    order = np.argsort(-score, kind="stable")
    s, last = score[order], np.append(score[order][1:] < score[order][:-1], True)
    good = np.flatnonzero((np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= PRECISION) & last)
    if not len(good):
        return float("inf") if len(y) else 0.5
    return max(0.5, float(s[good[-1]] + (s[good[-1] + 1] if good[-1] + 1 < len(s) else 0)) / 2)


def margin(trees: Trees) -> Column:
    """The trees' sum over the feature columns: the flattened nodes are array literals, and each tree is walked from its
    root to a leaf. The features enter as the fold's first value, so they are computed once."""
    if not len(trees.roots):
        return F.lit(float(trees.base))
    of = lambda a, kind: F.expr("array(" + ", ".join(f"{v!r}D" if kind is float else str(v) for v in map(kind, a)) + ")")
    feature, limit, left, value = of(trees.feature, int), of(trees.limit, float), of(trees.left, int), of(trees.value, float)
    start = F.struct(F.array(*[F.col(n) for n in features()]).alias("x"), F.lit(float(trees.base)).alias("sum"))

    def add(acc: Column, root: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            right = F.get(acc["x"], F.get(feature, at)) > F.get(limit, at)
            return F.when(F.get(feature, at) < 0, at).otherwise(F.get(left, at) + F.when(right, 1).otherwise(0))

        leaf = F.aggregate(of([0] * trees.depth, int), root, step)
        return F.struct(acc["x"].alias("x"), (acc["sum"] + F.get(value, leaf)).alias("sum"))

    return F.aggregate(of(trees.roots, int), start, add, lambda acc: acc["sum"])


def spans(df: DataFrame, model: Model, text: str = "text", out: str = "spans", keep_text: bool = False) -> DataFrame:
    """``df`` with ``out``: all spans ``(kind, start, end, base, score)`` of each text by start and kind; code points,
    end exclusive. The text itself only travels along if ``keep_text``."""
    row, rest = fresh("row"), fresh("rest")
    gone = {out.lower()} if keep_text else {out.lower(), text.lower()}
    keep = [F.col(c) for c in df.columns if c.lower() not in gone]
    inner = (df.select(F.col(text).alias("t"), (F.struct(*keep) if keep else F.lit(None).cast("int")).alias(rest))
             .withColumn(row, F.monotonically_increasing_id()))
    found = candidates(inner, "t", [row], [rest])
    found = found.select(rest, row, "gen", "at", "gap", F.char_length("m").cast("long").alias("size"),
                         valid(F.col("gen"), F.col("m")).alias("base"), *[c.alias(f) for f, c in features().items()])
    limit = F.lit(float("inf"))
    for n, v in model.limits.items():
        limit = F.when(F.col("gen") == n, F.lit(float(v))).otherwise(limit)
    kind = F.element_at(F.array(*[F.lit(KINDS.index(g.kind)) for g in GENERATORS.values()]), F.col("gen") + 1)
    found = found.withColumn("score", 1 / (1 + F.exp(-margin(model.trees)))).select(
        rest, row, "gen", "at", "gap", "size", "base", kind.alias("kind"), "score", (F.col("base") | (F.col("score") >= limit)).alias("kept"))
    found = found.repartition(row)
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(row, "gen").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    # an added span gives way to base spans and to added ones before it
    ahead = Window.partitionBy(row).orderBy("start", "kind", F.desc("end"), "gen").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(row).orderBy(F.desc("start"), F.desc("kind"), F.asc("end"), F.desc("gen")).rowsBetween(Window.unboundedPreceding, -1)
    live = F.col("kept")
    clash = (F.coalesce(F.max(F.when(live, F.col("end"))).over(ahead) > F.col("start"), F.lit(False))
             | F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(back) < F.col("end"), F.lit(False)))
    found = found.withColumn("kept", live & (F.col("base") | ~clash))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", "end", name.alias("name"), "base", F.when(F.col("base"), 1.0).otherwise(F.col("score")).alias("score"))
    made = found.groupBy(row).agg(F.first(rest, ignorenulls=True).alias(rest), F.sort_array(F.collect_list(F.when(F.col("kept"), span))).alias("s"))
    listed = F.transform("s", lambda s: F.struct(s["name"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score")))
    return made.select(*([f"{rest}.*"] if keep else []), listed.alias(out))


def listing(s: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, s: Column) -> Column:
    """A text with every span replaced by its kind in brackets; overlapping spans merge."""
    whole = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit("").alias("said"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substr(whole, (a["at"] + 1).cast("int"), F.greatest(x["start"] - a["at"], F.lit(0)).cast("int"))
        return F.when(x["end"] <= a["at"], a).otherwise(F.struct(
            F.when(x["start"] < a["at"], a["said"]).otherwise(F.concat(a["said"], gap, F.lit("["), x["kind"], F.lit("]"))).alias("said"), x["end"].alias("at")))

    return F.aggregate(s, start, step, lambda a: F.concat(a["said"], F.substr(whole, (a["at"] + 1).cast("int"))))
