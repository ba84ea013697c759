"""Personal data: generators propose spans with high recall, boosted trees over format and context score them, and thresholds
calibrated on left-out examples select what is redacted. Base spans by fixed formats always stay."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: In the order in which kinds that start together are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national", "secret")

# The base formats, written so that a run is tried once from its start and repeated groups don't recurse: what they match is
# what the plain formats match. \G is where the last match ended.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What proposes further spans. They may overlap each other and the base spans.
GENERATORS = {
    "email": r"(?i)(?<![\w.%+-])[\w.%+-]{1,64}+(?: ?@ ?| ?[(\[{] ?at ?[)\]}] ?)[\w-]{1,63}+(?:(?: ?\. ?| ?[(\[{] ?dot ?[)\]}] ?)[a-z0-9-]{2,63}){1,4}",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "card": r"(?<![0-9])(?<![0-9][ .-])(?:[0-9]{4}[ .-]{1,3}){3}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{13}(?![0-9])|(?<![0-9])3[0-9]{3}[ .-][0-9]{6}[ .-][0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])00[1-9][0-9]{0,2}(?:[ -]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i)(?<![a-z])(?:password|passwd|secret|token|api[_-]?key) ?[:=] ?[\"']?[^\s\"',;]{6,}+",
}
#: Characters of context on either side.
CONTEXT = 40
#: Code points in a piece of a text, where contexts are looked up; no fewer than CONTEXT.
PIECE = 1024
#: Made-up examples the trees are fitted on. Trees, their step, and the precision asked for.
EXAMPLES, TREES, STEP, PRECISION = 4096, 30, 0.4, 0.98
#: Groups of templates that are left out in turn.
GROUPS = 4


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(items: Column) -> Column:
    """The items, cut into about as many blocks as each has items; work that is quadratic in a block or in their number stays small."""

    def cut(xs: Column) -> Column:
        k = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        last = F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / k).cast("int"))
        return F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * k + 1, k)), lambda b: F.size(b) > 0)

    return bound(items, cut)


def spans(text: Column, pattern: str) -> Column:
    """All matches, as an array of (start, stop, value); positions are code points, stop is exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    kind = "struct<at:int,out:array<struct<start:int,stop:int,value:string>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,value:string>>").alias("out")).cast(kind)
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast("struct<at:int,out:array<int>>")

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + F.char_length(x["value"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("stop"), x["value"].alias("value")))).alias("out")).cast(kind)

    def placed(blocks: Column) -> Column:
        starts = F.aggregate(blocks, first, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        moved = lambda b, at: F.transform(b["out"], lambda x: F.struct((x["start"] + at).alias("start"), (x["stop"] + at).alias("stop"), x["value"].alias("value")))
        return F.flatten(F.zip_with(blocks, starts, moved))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), m.alias("value")))
    listed = bound(F.transform(in_blocks(pairs), lambda b: F.aggregate(b, start, add)), placed)
    return F.when(F.size(found) > 0, listed).otherwise(F.array().cast("array<struct<start:int,stop:int,value:string>>"))


def grouped(items: Column) -> Column:
    """Items sorted by their start, as blocks (low, high, items); low is the first start in a block and high the last stop."""
    return F.transform(in_blocks(items), lambda b: F.struct(F.get(b, F.lit(0))["start"].alias("low"), F.array_max(F.transform(b, lambda y: y["stop"])).alias("high"), b.alias("items")))


def meets(x: Column, blocks: Column, test: Callable[[Column], Column]) -> Column:
    """Whether test holds of any item that overlaps x; blocks that end before x or start after it are passed over."""
    over = lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])
    return F.exists(blocks, lambda b: (b["low"] < x["stop"]) & (x["start"] < b["high"]) & F.exists(b["items"], lambda y: over(y) & test(y)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: from the right, every second is doubled and its digits summed."""
    each = F.split(F.reverse(number), "")

    def term(x: Column, i: Column) -> Column:
        twice = x.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.transform(each, term), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.char_length(bare) <= 3) & (F.substring(bare, 1, 3).try_cast("int") <= 255)


BASE_TESTS: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small),
    "card": lambda v: F.char_length(digits(v)).between(14, 19) & luhn(digits(v)),
    "phone": lambda v: F.char_length(digits(v)).between(10, 15),
}
#: What a text must hold to hold a kind, cheap to see before any pattern is tried: that of the base formats, that of the generators.
#: digit says whether there is a digit at all, which is looked for once a text.
BASE_NEEDS: dict[str, Callable[[Column, Column], Column]] = {
    "email": lambda text, digit: F.contains(text, F.lit("@")),
    "ip": lambda text, digit: digit & text.rlike(r"[0-9]\.[0-9]"),
    "card": lambda text, digit: digit & text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
    "phone": lambda text, digit: digit & F.contains(text, F.lit("+")),
}
NEEDS: dict[str, Callable[[Column, Column], Column]] = {
    "email": lambda text, digit: F.contains(text, F.lit("@")) | (_any(text, "([{") & text.rlike(r"(?i)[(\[{] ?at ?[)\]}]")),
    "ip": lambda text, digit: F.contains(text, F.lit(":")) & text.rlike("(?i)[0-9a-f]:[0-9a-f]{1,4}:"),
    "card": lambda text, digit: digit & text.rlike("[0-9]{4}"),
    "phone": lambda text, digit: digit & text.rlike("[0-9]{3}"),
    "iban": lambda text, digit: digit & text.rlike("[A-Z]{2}[0-9]{2}"),
    "national": lambda text, digit: digit & F.contains(text, F.lit("-")),
    "secret": lambda text, digit: F.contains(text, F.lit("AKIA")) | _any(text, ":="),
}
_SPANS = "array<struct<start:int,stop:int,value:string>>"


def _any(text: Column, marks: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def base_spans(text: Column, kind: str, digit: Column) -> Column:
    found = F.filter(spans(text, BASE_PATTERNS[kind]), lambda x: BASE_TESTS[kind](x["value"]))
    return F.when(BASE_NEEDS[kind](text, digit), found).otherwise(F.array().cast(_SPANS))


def candidates(text: Column, digit: Column) -> Column:
    """What the generators propose: an array of (start, stop, value, kind number, before, after)."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(parts: Column, at: Column, n: Column) -> Column:  # n code points from at on, found without a walk through the text
        j = F.floor(at / PIECE).cast("int")
        near = F.concat(*[F.coalesce(F.get(parts, i), F.lit("")) for i in (j, j + 1)])
        return F.lower(F.substring(near, at - j * PIECE + 1, n))

    def proposed(kind: str, pattern: str) -> Column:
        made = lambda x, parts: F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"), F.lit(KINDS.index(kind)).alias("kind"),
            cut(parts, F.greatest(F.lit(0), x["start"] - CONTEXT), F.least(x["start"], F.lit(CONTEXT))).alias("before"),
            cut(parts, x["stop"], F.lit(CONTEXT)).alias("after"),
        )
        some = lambda xs: bound(F.when(F.size(xs) > 0, pieces), lambda parts: F.transform(xs, lambda x: made(x, parts)))
        return bound(F.when(NEEDS[kind](text, digit), spans(text, pattern)).otherwise(F.array().cast(_SPANS)), some)

    return F.concat(*[proposed(k, p) for k, p in GENERATORS.items()])


#: Yes-or-no features of a candidate x: its format, and what stands around it.
FEATURES: dict[str, Callable[[Column], Column]] = {
    **{f"is_{k}": (lambda x, n=n: x["kind"] == n) for n, k in enumerate(KINDS)},
    "at_sign": lambda x: x["value"].contains("@"),
    "spelled_at": lambda x: x["value"].rlike(r"(?i)[(\[{] ?at ?[)\]}]"),
    "known_domain_end": lambda x: x["value"].rlike(r"(?i)(?:\.|dot ?[)\]}]) ?(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$"),
    "luhn": lambda x: luhn(digits(x["value"])),
    "card_start": lambda x: digits(x["value"]).rlike("^(?:4|5[1-5]|3[47]|6|2[2-7])"),
    "all_digits_same": lambda x: digits(x["value"]).rlike(r"^([0-9])\1*$"),
    "few_digits": lambda x: F.char_length(digits(x["value"])) < 10,
    "many_digits": lambda x: F.char_length(digits(x["value"])) > 15,
    "area_code": lambda x: digits(x["value"]).rlike(r"^(?:00)?[2-9][0-9]{2}[2-9]"),
    "parentheses": lambda x: x["value"].rlike(r"^\("),
    "bad_national": lambda x: x["value"].rlike(r"^(?:000|666|9)|-00-|-0000$"),
    "mixed_value": lambda x: x["value"].rlike(r"[0-9]") & x["value"].rlike(r"[A-Za-z]"),
    "word_value": lambda x: x["value"].rlike(r"[:=] ?[\"']?[a-z]+$"),
    "placeholder": lambda x: x["value"].rlike(r"(?i)(?:x{4}|\*{4}|<|\$\{|your|example_|changeme|none|null)"),
    "says_contact": lambda x: x["before"].rlike(r"(?:phone|call|tel|mobile|cell|fax|contact|reach|whatsapp|telefon|teléfono|téléphone)"),
    "says_mail": lambda x: x["before"].rlike(r"(?:mail|write|contact|address|reach)"),
    "says_payment": lambda x: x["before"].rlike(r"(?:card|visa|master|amex|pay|credit|debit|account|iban|bank)"),
    "says_identity": lambda x: x["before"].rlike(r"(?:ssn|social|security|identity|national|passport)"),
    "says_number": lambda x: x["before"].rlike(r"(?:order|invoice|isbn|serial|part|version|build|item|article|figure|table|page|id|no\.|ref)[ #:]*$"),
    "says_measure": lambda x: x["after"].rlike(r"^ ?(?:%|kg|km|mm|cm|items|pages|rows|units|bytes|euro|usd|eur)"),
}


def _pick(options: list[str], salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))).cast("int") + 1)


def _number(n: int, salt: int) -> Column:
    """n digits, the first not 0."""
    return F.concat((F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(9)) + 1).cast("string"), *[F.pmod(F.xxhash64("id", F.lit(salt + 1 + i)), F.lit(10)).cast("string") for i in range(n - 1)])


def templates() -> list[tuple[int, Column]]:
    """(label, sentence): each form of personal data, or of what looks alike, after each of the words that may lead to it."""
    word = lambda s: _pick(["anna", "m.weber", "jlopez", "sales", "p_durand", "info", "kim22", "office"], s)
    host = lambda s: _pick(["mail", "example", "corp-net", "uni", "post9", "acme"], s)
    end = lambda s: _pick(["com", "org", "de", "net", "fr", "es"], s)
    area = F.concat((F.pmod(F.xxhash64("id", F.lit(91)), F.lit(8)) + 2).cast("string"), _number(2, 92), F.lit(""))
    local = F.concat((F.pmod(F.xxhash64("id", F.lit(95)), F.lit(8)) + 2).cast("string"), _number(2, 96))
    hexa = F.substring(F.sha2(F.col("id").cast("string").cast("binary"), 256), 1, 20)
    join = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    plain = ["", "and the", "then", "of the"]
    good = [
        (["mail me", "write to", "my address", "contact"], [join(word(2), " [at] ", host(3), " [dot] ", end(4)), join(word(2), "(at)", host(3), ".", end(4)), join(word(2), " @ ", host(3), ".", end(4))]),
        (["call me", "phone", "tel", "mobile", "fax", "reach us"], [join("(", area, ") ", local, "-", _number(4, 100)), join(area, "-", local, "-", _number(4, 100)), join(area, ".", local, ".", _number(4, 100))]),
        (["phone", "telefon", "call"], [join("0049 ", _number(3, 110), " ", _number(4, 120), " ", _number(3, 130)), join("0034 ", _number(3, 110), " ", _number(3, 120), " ", _number(3, 130))]),
        (["card", "visa", "pay with", "credit card"], [_pick([x], 8) for x in ("4111.1111.1111.1111", "5500 - 0000 - 0000 - 0004", "3782 822463 10005", "4012.8888.8888.1881", "4222222222222", "5105.1051.0510.5100")]),
        (["iban", "bank account", "pay to"], [join(c, _number(2, 140), *[y for i in range(n) for y in (" ", _number(4, 145 + 5 * i))], *t) for c, n, t in (("DE", 4, (" ", _number(2, 165))), ("ES", 5, ()), ("FR", 5, (" ", _number(3, 175))), ("GB", 4, (" ", _number(2, 165))))]),
        (["ssn", "social security", "identity"], [join(x, _number(2, 170), "-", _number(2, 175), "-", _number(4, 180)) for x in "1258"]),
        (["config", "login", "set"], [join(x, hexa) for x in ("password=", "token = \"", "secret: ", "api_key=", "passwd: ", "api-key = ")]),
        (["key", "using", "config"], [join("AKIA", F.upper(F.substring(hexa, 1, 16)))]),
        (["host", "server", "from"], [join(*[x for i in range(7) for x in (F.substring(hexa, i + 1, n), F.lit(":"))], F.substring(hexa, 9, n)) for n in (4, 3)]),
    ]
    bad = [
        (["order no.", "item", "ref", "invoice"], [join(_number(3, 200), "-", _number(3, 205), "-", _number(4, 210)), join(_number(3, 200), ".", _number(3, 205), ".", _number(4, 210))]),
        (["part #", "serial", "version", "article"], [join(_number(4, 215), ".", _number(4, 220), ".", _number(4, 225), ".", _number(4, 230)), join("1111 1111 1111 1111"), join("0000.0000.0000.0000")]),
        (["serial", "isbn", "item", "id"], [_number(13, 235)]),
        (["invoice 9", "form", "table"], [join("000-00-", _number(4, 250)), join("666-", _number(2, 252), "-0000"), join("9", _number(2, 254), "-00-", _number(4, 250))]),
        (["a total of", "some", "about"], [join("1", _number(2, 255), " 1", _number(2, 260), " ", _number(4, 265), " items"), join("1", _number(2, 255), " 1", _number(2, 260), " ", _number(4, 265), " rows")]),
        (["set", "the", "use"], [join(x, y) for x in ("password=", "token: ", "secret: ") for y in ("yourpassword", "changeme", "<value>", "${TOKEN}", "none-given", "required")]),
        (["the", "a", "of the"], [join(x, y) for x in ("token: ", "secret: ") for y in ("ourselves", "gestures", "symbols", "appreciation")]),
        (["article", "form"], [join("XX00 AAAA BBBB CCCC DDDD"), join("AB12 VERY LONG WORD LIST")]),
    ]
    neutral = ["", "and the", "then"]
    made = [(1, F.concat_ws(" ", F.lit(lead), form)) for leads, forms in good for lead in (*leads, *plain) for form in forms]
    return made + [(0, F.concat_ws(" ", F.lit(lead), form)) for leads, forms in bad for lead in (*leads, *neutral[: 1 + len(leads) // 4]) for form in forms]


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """Made-up sentences (id, template, text, label): those of label 1 hold personal data in forms that the base formats miss, those of
    label 0 hold what looks alike. Half are of either; n is how many."""
    every = templates()
    frame = spark.range(n)
    parts = []
    for label in (1, 0):
        own = [(k, text) for k, (y, text) in enumerate(every) if y == label]
        pick = F.pmod(F.xxhash64("id", F.lit(78)), F.lit(len(own))).cast("int")
        some = frame.where(F.pmod(F.xxhash64("id", F.lit(77)), F.lit(2)) == label)
        parts.append(some.select("id", F.element_at(F.array(*[F.lit(k) for k, _ in own]), pick + 1).alias("template"), F.element_at(F.array(*[t for _, t in own]), pick + 1).alias("text"), F.lit(label).alias("label")))
    return parts[0].unionByName(parts[1])


class Trees:
    """Boosted trees of depth two over yes-or-no features, fitted to log-odds; fit() works on counts of equal feature vectors."""

    def __init__(self) -> None:
        self.start, self.trees = 0.0, []

    @staticmethod
    def _leaf(rows: list, pred: list[float], on: list[int]) -> tuple[float, float]:
        g = sum(rows[i][1] - rows[i][2] / (1 + math.exp(-pred[i])) for i in on)
        h = sum(rows[i][2] * (p := 1 / (1 + math.exp(-pred[i]))) * (1 - p) for i in on) + 1.0
        return g / h, g * g / h

    def fit(self, vectors: dict[tuple, list[int]], trees: int = TREES, step: float = STEP) -> Trees:
        """vectors: feature vector -> [positives, rows]."""
        rows = [(v, a, n) for v, (a, n) in vectors.items()]
        if not rows:
            return self
        whole, good = sum(r[2] for r in rows), sum(r[1] for r in rows)
        self.start = math.log((good + 1) / (whole - good + 1))
        pred, width = [self.start] * len(rows), len(rows[0][0])

        def split(on: list[int]) -> tuple:
            best = (-1.0, None, None, None)
            for f in range(width):
                yes, no = [i for i in on if rows[i][0][f]], [i for i in on if not rows[i][0][f]]
                if yes and no and (gain := self._leaf(rows, pred, yes)[1] + self._leaf(rows, pred, no)[1]) > best[0]:
                    best = (gain, f, yes, no)
            return best[1:]

        for _ in range(trees):
            f, yes, no = split([*range(len(rows))])
            if f is None:
                break
            sides = []
            for on in (no, yes):
                g, b, a = split(on)
                leaves = [(g, step * self._leaf(rows, pred, x)[0]) for x in (a, b)] if g is not None else [(None, step * self._leaf(rows, pred, on)[0])] * 2
                sides.append((g, leaves[0][1], leaves[1][1]))
            self.trees.append((f, *sides))
            for i, (v, _, _) in enumerate(rows):
                pred[i] += self._one(self.trees[-1], v)
        return self

    @staticmethod
    def _one(tree: tuple, v: tuple) -> float:
        g, low, high = tree[1 + bool(v[tree[0]])]
        return high if g is not None and v[g] else low

    def score(self, v: tuple) -> float:
        return self.start + sum(self._one(t, v) for t in self.trees)

    def column(self, features: Column) -> Column:
        """The score as an expression over an array of booleans."""

        def side(g, low, high):
            return F.lit(float(low)) if g is None else F.when(F.get(features, F.lit(g)), F.lit(float(high))).otherwise(F.lit(float(low)))

        out = F.lit(float(self.start))
        for f, no, yes in self.trees:
            out = out + F.when(F.get(features, F.lit(f)), side(*yes)).otherwise(side(*no))
        return out


def _vector(x: Column) -> Column:
    return F.array(*[F.coalesce(f(x), F.lit(False)) for f in FEATURES.values()])


@functools.lru_cache(4)
def _model(n: int, trees: int, precision: float, session: str, spark: SparkSession) -> tuple[Trees, tuple[float, ...]]:
    made = examples(spark, n)
    seen = made.select("template", "label", F.explode(candidates(F.col("text"), has_digit(F.col("text")))).alias("x"))
    rows = seen.select("template", "label", F.col("x.kind").alias("kind"), F.transform(F.array(F.col("x")), _vector)[0].alias("v")).collect()  # at most a few for each of the n examples

    def fitted(keep: Callable[[int], bool]) -> Trees:
        table: dict[tuple, list[int]] = {}
        for r in rows:
            if keep(r["template"]):
                cell = table.setdefault(tuple(r["v"]), [0, 0])
                cell[0] += r["label"]
                cell[1] += 1
        return Trees().fit(table, trees)

    # each template is judged by trees that saw none of its sentences
    parts = [fitted(lambda t, g=g: t % GROUPS != g) for g in range(GROUPS)]
    limits = []
    for k in range(len(KINDS)):
        held = sorted(((parts[r["template"] % GROUPS].score(tuple(r["v"])), r["label"]) for r in rows if r["kind"] == k), reverse=True)
        best, good = math.inf, 0
        for i, (s, y) in enumerate(held):
            good += y
            if good >= precision * (i + 1) and (i + 1 == len(held) or held[i + 1][0] < s):
                best = s - 0.5 if i + 1 == len(held) else (s + held[i + 1][0]) / 2
        limits.append(best)
    return fitted(lambda t: True), tuple(limits)


def model(spark: SparkSession, n: int = EXAMPLES, trees: int = TREES, precision: float = PRECISION) -> tuple[Trees, tuple[float, ...]]:
    """The trees, and for each kind the lowest score at which examples above it, judged by trees that never saw their template, are personal
    data with that precision."""
    return _model(n, trees, precision, spark.sparkContext.applicationId, spark)


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, base and added, arrays of (start, kind, stop) with kind a position in KINDS, both sorted;
    text is passed on, for redact().

    Null texts count as empty. Added spans are candidates over their kind's threshold that overlap no base span and no better candidate.
    Each text is judged by itself: repeated rows, ties and empty tables need no rule. Positions are in code points, stop exclusive.
    """
    trees, limits = model(docs.sparkSession)
    kind = "array<struct<start:int,kind:int,stop:int>>"
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digit", has_digit(F.col("text")))
    rows = rows.withColumns({k: base_spans(F.col("text"), k, F.col("digit")) for k in BASE_KINDS})

    def numbered(name: str) -> Column:
        return F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(name)).alias("kind"), x["stop"].alias("stop")))

    base = F.concat(*map(numbered, BASE_KINDS))
    rows = rows.select("doc_id", "text", F.sort_array(base).cast(kind).alias("base"), candidates(F.col("text"), F.col("digit")).alias("cands"))
    limit = F.array(*[F.lit(float(x)) for x in limits])
    free = bound(grouped(F.col("base")), lambda g: F.filter("cands", lambda x: ~meets(x, g, lambda y: F.lit(True))))
    rows = rows.withColumn("cands", F.when(F.size("cands") > 0, free).otherwise(F.col("cands")))
    scored = F.transform("cands", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), F.aggregate(F.array(_vector(x)), F.lit(0.0), lambda _, v: trees.column(v)).alias("score")))
    rows = rows.withColumn("cands", F.sort_array(F.filter(scored, lambda x: x["score"] >= F.get(limit, x["kind"]))))
    better = lambda y, x: (y["score"] > x["score"]) | ((y["score"] == x["score"]) & ((y["start"] < x["start"]) | ((y["start"] == x["start"]) & (y["kind"] < x["kind"]))))
    best = bound(grouped(F.col("cands")), lambda g: F.filter("cands", lambda x: ~meets(x, g, lambda y: better(y, x))))
    added = F.sort_array(F.transform(best, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"))))
    return rows.select("doc_id", "text", "base", added.cast(kind).alias("added"))


def listed(found: Column) -> Column:
    """kind:start:stop of each, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(found: DataFrame) -> DataFrame:
    """(doc_id, text) of what personal_data() gave, with each span replaced by its kind in angle brackets; of overlapping base spans
    the first is named and the rest of the stretch goes with it."""
    kind = "struct<at:int,out:array<string>>"
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(kind)
    names = F.array(*map(F.lit, KINDS))

    def block(done: Column, xs: Column) -> Column:  # looks at the stretch of the text that the block covers
        to = F.array_max(F.transform(xs, lambda x: x["stop"]))

        def within(stretch: Column) -> Column:
            def add(acc: Column, x: Column) -> Column:
                gap = F.substring(stretch, acc["at"] - done["at"] + 1, x["start"] - acc["at"])
                new = F.when(x["start"] >= acc["at"], F.array(F.concat(gap, F.lit("<"), F.get(names, x["kind"]), F.lit(">")))).otherwise(F.array().cast("array<string>"))
                return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.concat(acc["out"], new).alias("out")).cast(kind)

            return F.aggregate(xs, F.struct(done["at"].alias("at"), F.array().cast("array<string>").alias("out")).cast(kind), add)

        inner = bound(F.substring(F.col("text"), done["at"] + 1, to - done["at"]), within)
        return bound(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(done["out"], F.array(F.array_join(i["out"], ""))).alias("out")).cast(kind))

    done = F.aggregate(in_blocks(F.sort_array(F.concat("base", "added"))), state, block)
    rest = F.substring(F.col("text"), F.col("done.at") + 1, F.char_length("text"))
    return found.withColumn("done", done).select("doc_id", F.concat(F.array_join("done.out", ""), rest).alias("text"))
