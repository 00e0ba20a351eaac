"""Personal data: candidate spans scored by gradient-boosted trees, beside exact base spans.

Everything on the main path is DataFrame expressions. Base spans follow the written rules. Generators of high recall
propose further spans (spelled-out mail addresses, phone numbers without a plus, cards with other separators,
IPv6); boosted trees score a candidate by its format and surroundings. The trees are trained by Spark ML on a
bounded set of constructed examples, their thresholds calibrated on a held-out part, and then written
out as one SQL expression, so that scoring needs neither a shuffle nor Python.
"""

from __future__ import annotations

import random
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import common

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 4000
PRECISION = 0.99
TREES = 12

# A match may start where the last one ended or where a run starts: runs are tried once, not at each character.
_RUN = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_RUN})){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_NEEDS = {"email": "contains(text, '@')", "ip": "contains(text, '.')", "card": None, "phone": "contains(text, '+')"}
_AT, _DOT = r"(?i:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20|\x20?@\x20?)", r"(?i:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)"
CANDIDATES = {
    "spelled": rf"(?:\G|(?<!{_RUN})){_RUN}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "digits": r"(?:\+|\()?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+",
    "colons": r"(?:\G|(?<![0-9A-Fa-f:]))[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){4,7}+",
}
CANDIDATE_NEEDS = {"spelled": None, "digits": None, "colons": "contains(text, ':')"}
# Parts of a run of digits begin and end at its groups. Cards have at most 19 digits and phone numbers 15, so longer parts are neither.
_GROUP, PART_DIGITS = "[+(]?[0-9]+", (7, 19)

_SPAN = "array<struct<start:int,end:int,s:string,before:string,after:string>>"
_STEP = 512


def _found(text: str, pattern: str, needs: Column) -> tuple[Column, Column]:
    """Matches of a pattern and the text around them, where the text can have any."""
    none = F.array().cast("array<string>")
    return F.when(needs, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(needs, F.split(text, pattern, -1)).otherwise(none)


def _spans(found: str, gaps: str) -> str:
    """Places of the matches: running sums of lengths, in steps so that long lists stay cheap."""
    rows = f"zip_with(zip_with({found}, slice({gaps}, 1, size({found})), (s, g) -> struct(s, g)), slice({gaps}, 2, size({found})), (x, h) -> named_struct('s', x.s, 'before', x.g, 'after', h))"
    return f"""
        CASE WHEN size({found}) = 0 THEN cast(array() AS {_SPAN}) ELSE
        transform(array({rows}), r ->
          transform(array(transform(sequence(0, (size(r) - 1) div {_STEP}), c -> slice(r, c * {_STEP} + 1, {_STEP}))), parts ->
            flatten(zip_with(parts,
              slice(aggregate(parts, array(0), (at, p) -> array_append(at, element_at(at, -1) + aggregate(p, 0, (n, x) -> n + length(x.before) + length(x.s)))), 1, size(parts)),
              (p, start) -> aggregate(p, named_struct('at', start, 'out', cast(array() AS {_SPAN})),
                (acc, x) -> named_struct('at', acc.at + length(x.before) + length(x.s), 'out', array_append(acc.out, named_struct(
                  'start', acc.at + length(x.before), 'end', acc.at + length(x.before) + length(x.s), 's', x.s, 'before', right(x.before, 24), 'after', left(x.after, 8)))),
                acc -> acc.out))))[0])[0] END"""


def _parts(runs: str) -> str:
    """The runs of digits, and of each every part from one group to another that a card or phone number can be."""
    least, most = PART_DIGITS
    groups = f"transform(array(named_struct('f', regexp_extract_all(w.s, '{_GROUP}', 0), 'g', split(w.s, '{_GROUP}', -1))), q -> {_spans('q.f', 'q.g')})[0]"
    # Texts are joined from the groups around, so that a part costs the same in a long run.
    joined = lambda start, n: f"array_join(transform(slice(gs, {start} + 1, {n}), t -> t.before || t.s), '')"
    lead = f"right(concat(w.before, {joined('greatest(i - 24, 0)', 'least(i, 24)')}, gs[i].before), 24)"
    text = f"gs[i].s || {joined('i + 1', 'j - i')}"
    ends = f"filter(transform(sequence(i, least(i + {most - 1}, size(gs) - 1)), j -> named_struct('j', j, 's', {text})), e -> NOT (i = 0 AND e.j = size(gs) - 1) AND length(translate(e.s, ' ().+/-', '')) BETWEEN {least} AND {most})"
    part = f"named_struct('start', w.start + gs[i].start, 'end', w.start + gs[e.j].end, 's', e.s, 'before', lead, 'after', left({joined('e.j + 1', 8)} || w.after, 8))"
    return f"flatten(transform({runs}, w -> concat(array(w), transform(array({groups}), gs -> flatten(transform(sequence(0, size(gs) - 1), i -> transform(array({lead}), lead -> transform({ends}, e -> {part}))[0])))[0])))"


BASE_KEEPS = {
    "email": "true",
    "ip": "NOT exists(split(x.s, '[.]'), p -> coalesce(try_cast(p AS int), 999) > 255)",
    "card": "length(regexp_replace(x.s, '[^0-9]', '')) BETWEEN 13 AND 19 AND luhn_check(regexp_replace(x.s, '[^0-9]', ''))",
    "phone": "length(regexp_replace(x.s, '[^0-9]', '')) BETWEEN 9 AND 15",
}

# A candidate's kind follows from its shape.
_KIND = {
    "spelled": "'email'",
    "digits": "CASE WHEN length(regexp_replace(x.s, '[^0-9]', '')) >= 12 AND NOT x.s RLIKE '^[+(]' THEN 'card' ELSE 'phone' END",
    "colons": "'ip'",
}

_D = "regexp_replace(x.s, '[^0-9]', '')"
FEATURES = {
    "email": "CASE WHEN x.kind = 'email' THEN 1D ELSE 0D END",
    "card": "CASE WHEN x.kind = 'card' THEN 1D ELSE 0D END",
    "phone": "CASE WHEN x.kind = 'phone' THEN 1D ELSE 0D END",
    "size": "cast(length(x.s) AS double)",
    "digits": f"cast(length({_D}) AS double)",
    "luhn": f"CASE WHEN length({_D}) BETWEEN 13 AND 19 AND luhn_check({_D}) THEN 1D ELSE 0D END",
    "groups": "cast(size(split(x.s, '[^0-9A-Za-z]+')) AS double)",
    "plus": "CASE WHEN x.s LIKE '+%' THEN 1D ELSE 0D END",
    "paren": "CASE WHEN x.s RLIKE '[(][0-9]{2,4}[)]' THEN 1D ELSE 0D END",
    "slash_or_dot": "CASE WHEN x.s RLIKE '[0-9][./][0-9]' THEN 1D ELSE 0D END",
    "spelled": "CASE WHEN x.s RLIKE '(?i)[^a-z](at|dot)[^a-z]' THEN 1D ELSE 0D END",
    "marked": "CASE WHEN x.s RLIKE '(?i)[@(\\\\[{]' THEN 1D ELSE 0D END",
    "ending": "CASE WHEN x.s RLIKE '(?i)[^a-z](com|org|net|edu|info|io|de|fr|es|it|nl|eu|uk)$' THEN 1D ELSE 0D END",
    "glued_before": "CASE WHEN x.before RLIKE '[A-Za-z0-9_]$' THEN 1D ELSE 0D END",
    "glued_after": "CASE WHEN x.after RLIKE '^[A-Za-z0-9_]' THEN 1D ELSE 0D END",
    "quoted": "CASE WHEN x.before RLIKE '[\"=#]\\\\s?$' THEN 1D ELSE 0D END",
    "phone_word": "CASE WHEN x.before RLIKE '(?i)(tel|phone|call|fax|mobile|cell)[^0-9]*$' THEN 1D ELSE 0D END",
    "card_word": "CASE WHEN x.before RLIKE '(?i)(card|visa|credit|pay)[^0-9]*$' THEN 1D ELSE 0D END",
    "mail_word": "CASE WHEN x.before RLIKE '(?i)(mail|contact|write|reach)[^0-9@]*$' THEN 1D ELSE 0D END",
    "number_word": "CASE WHEN x.before RLIKE '(?i)(id|no|order|ref|version|build|serial|token|hash|key|page|isbn)[^0-9]*$' THEN 1D ELSE 0D END",
    "colon_groups": "cast(length(regexp_replace(x.s, '[^:]', '')) AS double)",
    "hex_letters": "cast(length(regexp_replace(x.s, '[^A-Fa-f]', '')) AS double)",
    "fours": "CASE WHEN x.s RLIKE '^[0-9]{4}([^0-9]+[0-9]{4}){2,3}([^0-9]+[0-9]{1,3})?$' OR x.s RLIKE '^[0-9]+$' THEN 1D ELSE 0D END",
    "run_before": "CASE WHEN x.before RLIKE '[0-9][ ()./-]{0,2}$' THEN 1D ELSE 0D END",
    "run_after": "CASE WHEN x.after RLIKE '^[ ()./-]{0,2}[0-9]' THEN 1D ELSE 0D END",
}


def _luhn_tail(digits: str) -> str:
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Constructed candidates ``kind, s, before, after, label``: written forms of personal data and of other numbers and prose."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))
    digits = lambda k: str(r.randint(1, 9)) + "".join(str(r.randint(0, 9)) for _ in range(k - 1))
    prose = lambda: f"{word()} {word()} "

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a}/{b}{c}"])

    def card() -> str:
        d = digits(15)
        d += _luhn_tail(d)
        return r.choice([".", "  ", "/", " ", "-"]).join(d[k : k + 4] for k in range(0, 16, 4))

    def part(good: int) -> tuple[str, str, str, str]:
        """A part of a run of numbers: one of them, or a cut through them, more often one whose digits pass for a card."""
        held = [r.choice([phone, card])() for _ in range(r.choice([2, 2, 3, 4]))]
        if not good and r.random() < 0.4:
            date = lambda: r.choice([f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2099)}"])
            short = lambda: digits(r.randint(1, 3))
            held = [" ".join(r.choice([date, short])() if k % 2 else short() for k in range(r.randint(5, 16)))]
        elif r.random() < 0.4:
            held[0] = digits(r.randint(1, 4))  # such a number is none
        run, wholes = "", []
        for x in held:
            run += r.choice([" ", "/", "  "]) if run else ""
            wholes += [(len(run), len(run) + len(x))] if len(x) > 4 and len(held) > 1 else []
            run += x
        groups = [m.span() for m in re.finditer(_GROUP, run)]
        size = lambda a, b: sum(map(str.isdigit, run[a:b]))
        cuts = [(a, b) for i, (a, _) in enumerate(groups) for _, b in groups[i:] if (a, b) not in wholes and PART_DIGITS[0] <= size(a, b) <= PART_DIGITS[1]]
        numbers = {c: re.sub("[^0-9]", "", run[slice(*c)]) for c in cuts}
        close = [c for c, d in numbers.items() if len(d) >= 13 and _luhn_tail(d[:-1]) == d[-1]]
        a, b = r.choice(wholes if good else close if close and r.random() < 0.4 else cuts or [(0, len(run))])
        s, lead, tail = run[a:b], prose() + r.choice(["", "", "tel ", "card ", "call "]), r.choice([" ", ".", "\n"]) + word()
        return "card" if size(a, b) >= 12 and s[0] not in "+(" else "phone", s, (lead + run[:a])[-24:], (run[b:] + tail)[:8]

    out = []
    for i in range(n):
        before, after, good = prose(), r.choice([" ", ".", ",", "\n", ""]), i % 2
        kind = r.choice(KINDS)
        if kind in ("card", "phone") and r.random() < 0.4:
            out.append((*part(good), good))
            continue
        if kind == "email":
            host, end = word(), r.choice(["com", "org", "net", "info", "de", "fr"])
            if good:
                at, dot = r.choice([("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), (" at ", " dot "), (" @ ", ".")])
                s = f"{word()}{r.choice(['', '.' + word(), str(r.randint(1, 99))])}{at}{host}{dot}{end}"
                before += r.choice(["", "", "mail ", "contact: ", "write to "])
            else:
                s = r.choice([f"{word()} at {host}.{word()}", f"{word()} at {host} dot {word()}", f"{word()} @ {host}.{word()}"])
        elif kind == "card":
            if good:
                d = digits(15)
                d += _luhn_tail(d)
                s = r.choice([".", "  ", "/", " - "])[:2].join(d[k : k + 4] for k in range(0, 16, 4))
                before += r.choice(["", "card ", "visa: ", "credit card no "])
            else:
                d = digits(r.randint(12, 22))
                d = d[:-1] + str((int(d[-1]) + 1) % 10) if 13 <= len(d) <= 19 and _luhn_tail(d[:-1]) == d[-1] else d
                s = r.choice([d, " ".join(d[k : k + 4] for k in range(0, len(d), 4)), "-".join(d[k : k + 5] for k in range(0, len(d), 5))])
                before, after = r.choice([before, before + "order no ", before + 'id="', before + "token = "]), r.choice([after, "a3f"])
        elif kind == "phone":
            if good:
                a, b, c = digits(3), digits(3), digits(4)
                s = r.choice([f"({a}) {b}-{c}", f"1 ({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{r.randint(30, 49)} {a} {b} {c}", f"0{a}/{b}{c}", f"{a}.{b}.{c}"])
                before += r.choice(["tel ", "phone: ", "call ", "fax "]) if not s.startswith("(") and not s.startswith("1 (") else r.choice(["", "tel "])
            else:
                s = r.choice([f"{digits(4)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{digits(7)}", f"{digits(3)}.{digits(3)}.{digits(3)}", f"{digits(2)}.{r.randint(1, 12):02}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(10)}", f"{digits(4)}/{digits(4)}", f"{digits(r.randint(1, 4))} {digits(1)}.{digits(3)}.{digits(3)}", f"{digits(r.randint(1, 4))} {digits(2)}.{digits(4)}"])
                before, after = before + r.choice(["", "", "version ", "order no ", "page ", 'id="']), r.choice([after, "px", "b"])
        elif good:
            s = ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(8))
        else:
            s = r.choice([":".join(f"{r.randint(0, 59):02}" for _ in range(r.randint(5, 7))), "::::", ":".join(r.choice("abcdef") for _ in range(5))])
        out.append((kind, s, before[-24:], after, good))
    return out


def _tree_sql(lines: list[str], names: list[str]) -> str:
    """One tree of Spark's debug string as nested CASE expressions."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return line.removeprefix("Predict:").strip() + "D"
    feature, bound = re.match(r"If \(feature (\d+) <= ([-+.\dEe]+)\)", line).groups()
    yes = _tree_sql(lines, names)
    lines.pop(0)
    no = _tree_sql(lines, names)
    return f"CASE WHEN f.{names[int(feature)]} <= {bound}D THEN {yes} ELSE {no} END"


class Scorer:
    """The trained trees as SQL over a feature struct ``f``, and the calibrated threshold of each kind."""

    def __init__(self, spark: SparkSession, n: int = EXAMPLES, trees: int = TREES):
        names = list(FEATURES)
        # Numbered here and kept in one partition (their number is fixed), so that trees and thresholds are the same on every cluster.
        numbered = [(i, *x) for i, x in enumerate(examples(n))]
        rows = spark.createDataFrame(numbered, "i int, kind string, s string, before string, after string, label int").coalesce(1).select(F.struct("kind", "s", "before", "after").alias("x"), F.col("label").cast("double").alias("label"), "i")
        measured = common.stored(rows.select("label", F.expr("x.kind").alias("kind"), (F.xxhash64("i") % 4 == 0).alias("held"), *[F.expr(e).alias(c) for c, e in FEATURES.items()]), "pii-examples")
        shaped = VectorAssembler(inputCols=names, outputCol="features").transform(measured.withColumnRenamed("kind", "of").withColumnRenamed("held", "later"))
        model = GBTClassifier(maxIter=trees, maxDepth=4, stepSize=0.3, seed=5).fit(shaped.where("not later"))
        parts = [f"({w} * {_tree_sql([x for x in t.toDebugString.splitlines() if re.match(r'\s*(If|Else|Predict)', x)], names)})" for t, w in zip(model.trees, model.treeWeights, strict=True)]
        self.sql = f"1 / (1 + exp(-2 * ({' + '.join(parts)})))"
        self.thresholds = self._calibrate(measured)

    def _calibrate(self, measured: DataFrame) -> dict[str, float]:
        """Per kind the lowest of 19 thresholds whose held-out precision is high enough, else none passes."""
        scored = measured.where("held").select("kind", "label", F.struct(*FEATURES).alias("f")).withColumn("p", F.expr(self.sql))
        steps = [k / 20 for k in range(10, 20)]
        sums = [v for k, t in enumerate(steps) for v in (F.count_if(F.col("p") >= t).alias(f"n{k}"), F.count_if((F.col("p") >= t) & (F.col("label") == 1)).alias(f"g{k}"))]
        out = dict.fromkeys((*KINDS,), 2.0)
        for r in scored.groupBy("kind").agg(*sums).collect():
            good = [t for k, t in enumerate(steps) if r[f"n{k}"] and r[f"g{k}"] >= PRECISION * r[f"n{k}"]]
            out[r.kind] = min(good, default=2.0)
        return out


_SCORERS: dict[str, Scorer] = {}


def scorer(spark: SparkSession) -> Scorer:
    """Trained once for each application: the examples don't depend on the corpus."""
    key = spark.sparkContext.applicationId
    if key not in _SCORERS:
        _SCORERS[key] = Scorer(spark)
    return _SCORERS[key]


def find_spans(docs: DataFrame, trained: Scorer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its ``base`` spans and those the trees ``added``: arrays of ``kind, start, end`` (code points, end exclusive).

    Base spans are the leftmost non-overlapping matches of each kind that pass its test. Added spans overlap neither base
    ones nor each other: of overlapping ones that pass, the trees' best stays, then the first, then the longest. Null and empty texts have none; repeated rows are searched each; an empty table gives an empty table; other
    columns are not read. No shuffle.
    """
    spark = docs.sparkSession
    trained = trained or scorer(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("numbers", F.col("text").rlike("[0-9]"))
    for name, patterns, needs in (("b", BASE, BASE_NEEDS), ("c", CANDIDATES, CANDIDATE_NEEDS)):
        columns = {}
        for kind, pattern in patterns.items():
            wanted = (F.expr(needs[kind]) if needs[kind] else F.lit(True)) & (F.lit(True) if kind in ("email", "spelled", "colons") else F.col("numbers"))
            columns[f"{name}_{kind}"], columns[f"{name}_{kind}_gaps"] = _found("text", pattern, wanted)
        rows = rows.withColumns(columns)
    rows = rows.drop("text", "numbers")
    rows = rows.select("doc_id", *[F.expr(_spans(f"{n}_{k}", f"{n}_{k}_gaps")).alias(f"{n}_{k}") for n, p in (("b", BASE), ("c", CANDIDATES)) for k in p])
    rows = rows.withColumn("c_digits", F.expr(_parts("c_digits")))
    base = "concat(" + ", ".join(f"transform(filter(b_{k}, x -> {BASE_KEEPS[k]}), x -> named_struct('kind', '{k}', 'start', x.start, 'end', x.end))" for k in KINDS) + ")"
    proposed = "concat(" + ", ".join(f"transform(c_{k}, x -> named_struct('kind', {_KIND[k]}, 'start', x.start, 'end', x.end, 's', x.s, 'before', x.before, 'after', x.after))" for k in CANDIDATES) + ")"
    features = "named_struct(" + ", ".join(f"'{c}', {e}" for c, e in FEATURES.items()) + ")"
    least = "CASE y.kind " + " ".join(f"WHEN '{k}' THEN {t}D" for k, t in trained.thresholds.items()) + " END"
    rows = rows.select("doc_id", F.expr(base).alias("base"), F.expr(proposed).alias("proposed"))
    scored = f"transform(proposed, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'f', {features}))"
    rows = rows.withColumn("scored", F.expr(f"transform({scored}, y -> named_struct('kind', y.kind, 'start', y.start, 'end', y.end, 'p', transform(array(y.f), f -> {trained.sql})[0], 'least', {least}))"))
    rows = rows.withColumn("passed", F.expr("filter(scored, y -> y.p >= y.least AND NOT exists(base, b -> b.start < y.end AND b.end > y.start))"))
    ranked = "array_sort(transform(passed, y -> named_struct('p', -y.p, 'start', y.start, 'size', y.start - y.end, 'end', y.end, 'kind', y.kind)))"
    chosen = f"aggregate({ranked}, cast(array() AS array<struct<kind:string,start:int,end:int>>), (acc, y) -> CASE WHEN exists(acc, a -> a.start < y.end AND a.end > y.start) THEN acc ELSE array_append(acc, named_struct('kind', y.kind, 'start', y.start, 'end', y.end)) END)"
    return rows.select("doc_id", "base", F.expr(f"array_sort({chosen}, (a, b) -> a.start - b.start)").alias("added"))


def personal_data(docs: DataFrame, trained: Scorer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of the spans: counts of base spans, a hash of theirs, all spans as text, and how many were added.

    Null and empty texts have no span and the hash of the empty text; repeated rows are searched each; texts of any length are
    searched whole; an empty table gives an empty table; other columns are not read. No shuffle.
    """
    order = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    joined = lambda spans: F.expr(f"array_join(transform(array_sort(transform({spans}, x -> named_struct('o', {order}, 'start', x.start, 'end', x.end, 'kind', x.kind))), x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    return find_spans(docs, trained, id_col, text_col).select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("concat(base, added)").alias("spans"), F.expr("cast(size(added) AS long)").alias("n_added"))
