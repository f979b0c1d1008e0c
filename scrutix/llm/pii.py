"""Personal data by candidate gradient boosting, in SQL functions only.

High-recall generators (regular expressions, linear in the text) propose
spans that may overlap.  A candidate's format (digits, letters, separators,
checksums, distinct characters, kinds of characters) and context (words to its
left, characters beside it) are features of small boosted trees.  Calibrated
thresholds a kind select candidates; of those that overlap, the more probable
one is added, and none that overlaps a base span: base spans always stay.

Spark has no match offsets: matches and the gaps between them (a split on the
same pattern) give both offsets and contexts.  Nothing is shuffled.  The trees
are fitted on the driver from generated examples (``examples``) and become
CASE expressions.

Defined results: a null text is empty, without spans; repeated rows give
repeated results; patterns are possessive, so very long digit or letter runs
take linear time and no stack; extra columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"

#: Base patterns; possessive forms of the contract's, which they equal:
#: a run of local characters (or digits) matches from its start or not at all.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass before its pattern is tried.
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: A secret's value, of any length, ends at white space or a double quote; brackets,
#: commas and the like belong to it if more of it follows them.
VALUE = r"[A-Za-z0-9\u00C0-\u024F_+/.!@#$%^&*?~=:-]"
INNER = r"[,;|()\[\]{}<>\\'`]"

#: Generators of further candidates (kind, pattern, guard); the span is the whole match.
GENERATORS = {
    "email_words": ("email", rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]{{1,63}}+){{1,4}}+", r"(?:\[at\]|\(at\)|\x20at\x20)"),
    "card_any": ("card", r"(?<![0-9.+-])[0-9]{4}(?:[\x20-]?[0-9]{2,6}+){2,4}+(?![0-9-])", r"[0-9]{4}[\x20-]?[0-9]{4,6}"),
    "phone_local": ("phone", r"(?<![0-9+.-])(?<![0-9+][\x20(])\(?[0-9]{2,5}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9-]|[\x20.][0-9])", r"[0-9]{2}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3}"),
    "ssn": ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "secret": ("secret", rf"(?i)(?<![a-z])(?:token|password|passwd|secret|api[_-]?key)[\x20\t]?[:=][\x20\t]?\"?(?:{VALUE}|{INNER}++(?={VALUE})){{8,}}+\"?", r"(?i)(?:token|password|passwd|secret|key)[\x20\t]?[:=]"),
    "iban": ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
}
KINDS = ("email", "ip", "card", "phone", "ssn", "secret", "iban")

CUES = r"mail|contact|write|reach|phone|call|tel|fax|mobile|cell|ring|dial|card|visa|credit|pay|ssn|social|security|login|auth|export|config|iban|account|bank|transfer"
ANTI = r"order|invoice|version|isbn|ref|page|sku|part|serial|example|table|figure|ticket|batch|tracking|meet|arrive|look|model|score|sum"
CONTEXT = 32

#: Words beside a candidate, for training and (second) for the held-out figures:
#: those of personal data, of other numbers, and of neither.
WORDS = {
    "email_words": (("contact ", "write to ", "e-mail: ", "reach me: "), ("my address is ", "send mail to ", "or contact ")),
    "card_any": (("card ", "visa: ", "credit card no ", "pay with "), ("charged to card ", "mastercard or visa ", "my credit card is ")),
    "phone_local": (("call ", "phone: ", "tel. ", "fax ", "mobile "), ("ring me on ", "telephone ", "dial ")),
    "ssn": (("ssn ", "social security number ", "ssn: "), ("her social security no. is ", "SSN=", "social: ")),
    "secret": (("", "config ", "export ", " login "), ("set ", "in the auth file: ", "then ")),
    "iban": (("iban ", "account ", "bank transfer to "), ("IBAN: ", "pay into account ", "our bank: ")),
}
OTHER = (("order ", "tracking ", "serial ", "batch ", "invoice ", "part ", "sku ", "version ", "isbn ", "page "), ("ref. ", "order no. ", "ticket ", "model ", "table "))
NEUTRAL = (("", "it was ", "the first ", "and "), ("we saw ", "then came ", "of "))
AFTER = ("", ".", ",", " or", " and")


def _number(r: random.Random, groups, sep: str, check: str = "") -> str:
    """Digits in groups; ``check``: 'luhn' or 'none' of it."""
    while True:
        n = "".join(r.choice("0123456789") for _ in range(sum(groups)))
        if check and _luhn(n) != (check == "luhn"):
            continue
        out, at = [], 0
        for g in groups:
            out.append(n[at : at + g])
            at += g
        return sep.join(out)


def _name(r: random.Random, least: int = 2, most: int = 9) -> str:
    return "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(least, most)))


def _iban(r: random.Random, right: bool) -> str:
    country, body = r.choice(("DE", "FR", "GB", "NL", "ES", "IT")), "".join(r.choice("0123456789") for _ in range(r.choice((14, 18, 20))))
    if r.random() < 0.3:
        body = "".join(r.choice("ABCDEFGHKLMN") for _ in range(4)) + body[4:]
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    code = f"{country}{(check if right else (check + r.randint(1, 60)) % 97):02d}{body}"
    return " ".join(code[i : i + 4] for i in range(0, len(code), 4)) if r.random() < 0.5 else code


def _span(r: random.Random, generator: str, label: int) -> str:
    """A span as the generator finds it, of personal data or not."""
    if generator == "email_words":
        at, dot = r.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot ")))
        if label:
            return f"{_name(r)}.{_name(r)}{at}{_name(r)}{dot}{r.choice(('org', 'net', 'com'))}"
        return f"{r.choice(('us', 'here', 'look', 'them'))} at {r.choice(('home', 'noon', 'work'))} dot {r.choice(('dot', 'then', 'so', 'line'))}"
    if generator == "card_any":
        groups = r.choice(((4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4)))
        return _number(r, groups, r.choice((" ", "-", "")), "luhn" if label or r.random() < 0.1 else "none")
    if generator == "phone_local":
        groups = r.choice(((3, 3, 4), (3, 3, 4), (3, 4, 4), (5, 3, 3)))
        n = _number(r, groups, r.choice((" ", "-", ".")))
        return f"({n[:3]}) {n[4:]}" if r.random() < 0.3 and groups[0] == 3 else n
    if generator == "ssn":
        area = r.randint(1, 665) if label else r.choice((0, 666, r.randint(900, 999), r.randint(1, 665)))
        return f"{area:03d}-{r.randint(1, 99) if label else r.choice((0, r.randint(1, 99))):02d}-{r.randint(1, 9999):04d}"
    if generator == "secret":
        key = r.choice(("token", "password", "passwd", "secret", "api_key", "api-key"))
        eq = r.choice(("=", ": ", " = ", ":"))
        if label:
            kind, n = r.random(), r.randint(10, 40)
            if kind < 0.3:
                value = "".join(r.choice("0123456789abcdef") for _ in range(n)) + "7"
            elif kind < 0.5:
                value = _name(r, 4, 8) + str(r.randint(2, 99)) + _name(r, 3, 8)
            else:
                value = "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789" + "!#$%_" * r.randint(0, 1)) for _ in range(n)) + str(r.randint(0, 9))
        else:
            value = r.choice(("different", "required", "everything", "a" * r.randint(8, 14), "something", "authentication", "nonetheless", _name(r, 8, 14)))
        q = r.choice(('"', "", ""))
        return f"{key}{eq}{q}{value}{q}"
    if label or r.random() < 0.4:
        return _iban(r, bool(label))
    return f"{r.choice(('AB', 'XX', 'SN'))}{r.randint(0, 99):02d} " + " ".join("".join(r.choice("ABCDEFGHJKLMNP0123456789") for _ in range(4)) for _ in range(r.randint(2, 4)))


def examples(held_out: bool = False, rows: int = 150) -> list[tuple[str, str, str, str, int]]:
    """The labelled table (generator, left, span, right, label), from a fixed seed.

    Personal data mostly stands beside its own words, at times beside neutral
    ones; other spans beside words of other numbers or neutral ones, at times
    beside those of personal data.  Held-out rows have other words and spans.
    """
    r, k = random.Random(20240 + held_out), int(held_out)
    out = []
    for g in GENERATORS:
        for label in (1, 0):
            for _ in range(rows):
                u = r.random()
                if g == "secret":
                    left = r.choice(WORDS[g][k] if u < 0.7 else NEUTRAL[k])
                elif label:
                    left = r.choice(WORDS[g][k] if u < 0.85 or g in ("phone_local",) else NEUTRAL[k])
                else:
                    # what only words can tell apart has no words of personal data
                    own = 0.1 if g in ("card_any", "iban", "email_words") else 0.0
                    left = r.choice(WORDS[g][k] if u < own else OTHER[k] if u < 0.6 else NEUTRAL[k])
                out.append((g, left, _span(r, g, label), r.choice(AFTER), label))
    return out


FEATURES = ("generator", "digits", "letters", "separators", "distinct", "luhn", "cue", "anti", "before", "after", "classes", "mod97", "zeros")


def _mod97(span: str) -> bool:
    code = re.sub("[^A-Z0-9]", "", span)
    return len(code) >= 15 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _classes(span: str) -> int:
    """How many of lower case, upper case, digits and other characters the value holds."""
    value = re.sub("^[^:=]*[:=]", "", span)
    return sum(bool(re.search(p, value)) for p in VALUE_CLASSES)


VALUE_CLASSES = ("[a-z]", "[A-Z]", "[0-9]", "[!#$%_&*@^+/-]")
#: Groups of zeros and areas that aren't given out.
ZEROS = r"(?:^|-)0+(?:-|$)|^9[0-9]{2}-|^666-"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def features_of(generator: str, left: str, span: str, right: str) -> list[float]:
    """Features of a training row; ``_features`` is the same in SQL."""
    digits = re.sub("[^0-9]", "", span)
    letters = re.sub("[^A-Za-z]", "", span)
    left = left[-CONTEXT:]
    return [
        float(list(GENERATORS).index(generator)),
        float(len(digits)),
        float(len(letters)),
        float(len(re.sub("[A-Za-z0-9]", "", span))),
        float(len(set(digits))),
        float(13 <= len(digits) <= 19 and _luhn(digits)),
        float(bool(re.search(CUES, left, re.I))),
        float(bool(re.search(ANTI, left, re.I))),
        float(bool(re.search("[A-Za-z0-9]$", left))),
        float(bool(re.search("^[A-Za-z0-9/]", right[:1]))),
        float(_classes(span) if generator == "secret" else 0),
        float(generator == "iban" and _mod97(span)),
        float(generator == "ssn" and bool(re.search(ZEROS, span))),
    ]


@dataclass
class Boosted:
    """Trees as nested tuples ``(feature, threshold, low, high)`` with floats as leaves."""

    trees: list
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict | None = None

    def raw(self, x: list[float]) -> float:
        return sum(_walk(t, x) for t in self.trees)

    def probability(self, x: list[float]) -> float:
        return 1 / (1 + math.exp(-(self.slope * self.raw(x) + self.shift)))


def _walk(tree, x: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _grow(xs, g, h, rows, depth: int, shrink: float):
    """A regression tree on gradients; the split with the largest gain, first feature on ties."""
    sg, sh = g[rows].sum(), h[rows].sum()
    leaf = float(-shrink * sg / (sh + 1.0))
    if depth == 0:
        return leaf
    best = (1e-6, None, None)
    for f in range(xs.shape[1]):
        order = rows[np.argsort(xs[rows, f], kind="stable")]
        v, lg, lh = xs[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        gain = lg[cuts] ** 2 / (lh[cuts] + 1) + (sg - lg[cuts]) ** 2 / (sh - lh[cuts] + 1) - sg * sg / (sh + 1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float(v[cuts[k]] + v[cuts[k] + 1]) / 2)
    if best[1] is None:
        return leaf
    _, f, cut = best
    low = xs[rows, f] <= cut
    return f, cut, _grow(xs, g, h, rows[low], depth - 1, shrink), _grow(xs, g, h, rows[~low], depth - 1, shrink)


def _boost(xs, ys, rounds: int, depth: int, shrink: float) -> list:
    raw, trees = np.zeros(len(xs)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        trees.append(_grow(xs, p - ys, p * (1 - p), np.arange(len(xs)), depth, shrink))
        raw = raw + np.array([_walk(trees[-1], x) for x in xs.tolist()])
    return trees


def fit(rows=None, rounds: int = 24, depth: int = 3, shrink: float = 0.4, folds: int = 5, precision: float = 0.95) -> Boosted:
    """Boosted trees, calibrated (Platt) on scores of folds they weren't fitted on.

    A kind's threshold is the least of 0.50, 0.55 ... 0.95 at which the folds'
    candidates of the kind reach ``precision`` (0.95 if none does).
    """
    rows = examples() if rows is None else rows
    xs = np.array([features_of(*e[:4]) for e in rows])
    ys = np.array([e[4] for e in rows], float)
    raw = np.zeros(len(xs))
    for k in range(folds):
        inside = np.arange(len(xs)) % folds != k
        trees = _boost(xs[inside], ys[inside], rounds, depth, shrink)
        raw[~inside] = [sum(_walk(t, x) for t in trees) for x in xs[~inside].tolist()]
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        a, b = a - 0.3 * (float(((p - ys) * raw).mean()) + 1e-3 * (a - 1)), b - 0.3 * float((p - ys).mean())
    p = 1 / (1 + np.exp(-(a * raw + b)))
    thresholds = {}
    for kind in dict.fromkeys(v[0] for v in GENERATORS.values()):
        own = np.array([GENERATORS[e[0]][0] == kind for e in rows])
        grid = [t / 100 for t in range(50, 100, 5)]
        good = [t for t in grid if (taken := own & (p >= t)).any() and ys[taken].mean() >= precision]
        thresholds[kind] = min(good, default=0.95)
    return Boosted(_boost(xs, ys, rounds, depth, shrink), a, b, thresholds)


_model: list[Boosted] = []


def model() -> Boosted:
    """The fitted trees, once a process."""
    if not _model:
        _model.append(fit())
    return _model[0]


# --- SQL side ----------------------------------------------------------------


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn_ok(digits: Column) -> Column:
    back = F.reverse(digits)
    # doubled digits with 9 taken off come from a translation
    twice = F.translate(back, "0123456789", "0246813579")
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, F.substring(twice, i, F.lit(1))).otherwise(F.substring(back, i, F.lit(1))).cast("int"))
    return total % 10 == 0


def _mod97_ok(m: Column) -> Column:
    """The check of an account number: its first four characters moved to the end, letters as two digits, modulo 97."""
    code = F.regexp_replace(m, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(code, 5, 99), F.left(code, F.lit(4)))
    value = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    step = lambda a, i: F.when(value(i) < 65, (a * 10 + value(i) - 48) % 97).otherwise((a * 100 + value(i) - 55) % 97).cast("int")
    return (F.length(code) >= 15) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1)


def _valid(kind: str, m: Column) -> Column:
    """Whether a base match passes its kind's test."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return m.rlike(rf"^(?:{part}\.){{3}}{part}$")
    n = F.length(_digits(m))
    if kind == "phone":
        return n.between(8, 15)
    return F.when(n.between(16, 19), _luhn_ok(_digits(m))).otherwise(False)


def _features(generator: str, left: Column, m: Column, right: Column) -> list[Column]:
    digits = _digits(m)
    near = F.right(left, F.lit(CONTEXT))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        F.lit(float(list(GENERATORS).index(generator))),
        F.length(digits).cast("double"),
        F.length(F.regexp_replace(m, "[^A-Za-z]", "")).cast("double"),
        F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")).cast("double"),
        F.size(F.array_distinct(F.filter(F.split(digits, ""), lambda x: x != ""))).cast("double"),
        yes(F.when(F.length(digits).between(13, 19), _luhn_ok(digits)).otherwise(False)),
        yes(near.rlike(f"(?i){CUES}")),
        yes(near.rlike(f"(?i){ANTI}")),
        yes(near.rlike(r"[A-Za-z0-9]\z")),
        yes(F.left(right, F.lit(1)).rlike("^[A-Za-z0-9/]")),
        sum((yes(F.regexp_replace(m, "^[^:=]*[:=]", "").rlike(p)) for p in VALUE_CLASSES), F.lit(0.0)) if generator == "secret" else F.lit(0.0),
        yes(_mod97_ok(m)) if generator == "iban" else F.lit(0.0),
        yes(m.rlike(ZEROS)) if generator == "ssn" else F.lit(0.0),
    ]


def _tree_sql(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(F.get(x, F.lit(tree[0])) <= tree[1], _tree_sql(tree[2], x)).otherwise(_tree_sql(tree[3], x))


def _pruned(tree, generator: int):
    """The tree with its tests on the generator decided."""
    if not isinstance(tree, tuple):
        return tree
    if tree[0] == 0:
        return _pruned(tree[2] if generator <= tree[1] else tree[3], generator)
    return tree[0], tree[1], _pruned(tree[2], generator), _pruned(tree[3], generator)


def _probability(trees: Boosted, generator: str, x: Column) -> Column:
    g = list(GENERATORS).index(generator)
    raw = F.lit(0.0)
    for t in trees.trees:
        raw = raw + _tree_sql(_pruned(t, g), x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(raw * trees.slope + trees.shift)))


def _matches(df: DataFrame, text: str, name: str, pattern: str, guard: str) -> DataFrame:
    """Adds ``name``: array of (gap before, match, gap after), empty without matches."""
    found = F.contains(F.col(text), F.lit("@")) if guard == "@" else F.col(text).rlike(guard)
    none = F.array().cast("array<string>")
    df = df.withColumn(f"{name}_m", F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    return df.withColumn(f"{name}_g", F.when(F.size(f"{name}_m") > 0, F.split(text, pattern, -1)).otherwise(none))


SPANS = "array<struct<start:long,end:long>>"
SCORED = "array<struct<start:long,end:long,p:double,kind:string>>"


def _spans(name: str, keep=None, chance=None) -> Column:
    """Offsets (start, end) of the matches for which ``keep(i, match)`` holds, or with (p, kind) from ``chance``."""
    m, g = F.col(f"{name}_m"), F.col(f"{name}_g")
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,i:int>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(g, i))
        end = (start + F.length(F.get(m, i))).cast("long")
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.cast("long").alias("start"), end.alias("end"), i.alias("i")))).alias("out"))

    every = F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), empty, step)["out"]
    if chance:
        kind = F.lit(GENERATORS[name][0])
        scored = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), chance(s["i"], F.get(m, s["i"])).alias("p"), kind.alias("kind")))
        return F.when(F.size(m) > 0, scored).otherwise(F.array().cast(SCORED))
    kept = F.transform(F.filter(every, lambda s: keep(s["i"], F.get(m, s["i"]))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.size(m) > 0, kept).otherwise(F.array().cast(SPANS))


def _chance(name: str, trees: Boosted):
    """Probability of match ``i`` of a generator."""
    g = F.col(f"{name}_g")

    def chance(i: Column, m: Column) -> Column:
        # features once, then the trees on them
        x = F.array(*_features(name, F.get(g, i), m, F.coalesce(F.get(g, i + 1), F.lit(""))))
        return F.get(F.transform(F.array(x), lambda v: _probability(trees, name, v)), F.lit(0))

    return chance


def _selected(name: str, trees: Boosted):
    """Whether the boosted trees select match ``i`` of a generator."""
    chance = _chance(name, trees)
    return lambda i, m: chance(i, m) >= trees.thresholds[GENERATORS[name][0]]


def _whole(columns) -> Column:
    """The input's columns as one struct, so their names can't meet the operator's."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row")


def _fields(columns) -> list[Column]:
    return [F.col("_row").getField(c).alias(c) for c in columns]


def find_spans(documents: DataFrame, text_col: str = "text", trees: Boosted | None = None) -> DataFrame:
    """``documents`` with ``base_<kind>`` and ``added_<kind>``: arrays of (start, end).

    Input columns of these names are replaced; all others are kept.
    """
    trees = trees or model()
    made = [f"base_{k}" for k in BASE] + [f"added_{k}" for k in KINDS]
    kept = [c for c in documents.columns if c not in made]
    df = documents.select(_whole(kept), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    for kind, pattern in BASE.items():
        df = _matches(df, "_text", f"_b_{kind}", pattern, GUARD[kind])
    for name, (_, pattern, guard) in GENERATORS.items():
        df = _matches(df, "_text", f"_{name}", pattern, guard)
        df = df.withColumnsRenamed({f"_{name}_m": f"{name}_m", f"_{name}_g": f"{name}_g"})
    out = {f"base_{kind}": _spans(f"_b_{kind}", _valid_match(kind)) for kind in BASE}
    raw = {name: _spans(name, chance=_chance(name, trees)) for name in GENERATORS}
    df = df.select("_row", *(c.alias(n) for n, c in out.items()), *(c.alias(f"_a_{n}") for n, c in raw.items()))
    least = F.create_map(*(F.lit(x) for kv in trees.thresholds.items() for x in kv))
    every = F.filter(F.concat(*(F.col(f"_a_{n}") for n in GENERATORS)), lambda s: s["p"] >= least[s["kind"]])
    df = df.select("_row", *out, F.concat(*out).alias("_base"), every.alias("_chosen"))
    df = df.withColumn("_added", F.filter("_chosen", lambda s: ~F.exists("_base", lambda b: _overlap(s, b)) & ~F.exists("_chosen", lambda o: _overlap(s, o) & _beats(o, s))))
    plain = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    of = lambda kind: lambda s: s["kind"] == kind
    added = {f"added_{k}": F.transform(F.filter("_added", of(k)), plain) for k in KINDS}
    return df.select(*_fields(kept), *out, *(c.alias(n) for n, c in added.items()))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _beats(a: Column, b: Column) -> Column:
    """More probable; of equals, the earlier kind, then the earlier start."""
    return (a["p"] > b["p"]) | ((a["p"] == b["p"]) & ((a["kind"] < b["kind"]) | ((a["kind"] == b["kind"]) & (a["start"] < b["start"]))))


def _joined(parts: list[tuple[str, Column]]) -> Column:
    text = lambda kind: lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.concat(*(F.transform(F.array_sort(c), text(k)) for k, c in parts)), ",")


def _valid_match(kind: str):
    return lambda i, m: _valid(kind, m)


def _replaced(name: str, keep, tag: Column) -> Column:
    """The text with the matches for which ``keep`` holds replaced by ``tag``."""
    m, g = F.col(f"{name}_m"), F.col(f"{name}_g")
    pieces = F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.concat(F.get(g, i), F.when(keep(i, F.get(m, i)), tag).otherwise(F.get(m, i))))
    return F.when(F.size(m) > 0, F.concat(F.array_join(pieces, ""), F.get(g, F.size(m)))).otherwise(F.col("_r"))


def redact(documents: DataFrame, text_col: str = "text", trees: Boosted | None = None) -> DataFrame:
    """``documents`` with every selected span of ``text_col`` replaced by its kind's tag.

    Kinds are replaced one after the other (base matches and the boosted
    trees' choices), each in one linear pass; a null text stays null.
    """
    trees = trees or model()
    kept = documents.columns
    df = documents.select(_whole(kept), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_r"))
    steps = [(k, f"b_{k}", p, GUARD[k], None) for k, p in BASE.items()] + [(v[0], n, v[1], v[2], n) for n, v in GENERATORS.items()]
    # secrets first: their values may hold digits; then base kinds, then the rest
    steps.sort(key=lambda s: (s[1] != "secret", s[4] is not None))
    for kind, name, pattern, guard, generator in steps:
        df = _matches(df, "_r", name, pattern, guard)
        keep = _selected(generator, trees) if generator else _valid_match(kind)
        df = df.withColumn("_r", _replaced(name, keep, F.lit(f"[{kind.upper()}]"))).drop(f"{name}_m", f"{name}_g")
    text = F.when(F.col("_row").getField(text_col).isNotNull(), F.col("_r"))
    return df.select(*(text.alias(c) if c == text_col else x for c, x in zip(kept, _fields(kept))))


def op9_pii(documents: DataFrame) -> DataFrame:
    """Counts and digests of base spans, and all spans."""
    df = find_spans(documents.select("doc_id", "text"))
    base = [(k, F.col(f"base_{k}")) for k in BASE]
    every = [(k, F.concat(*(F.col(f"{p}_{k}") for p in ("base", "added") if p == "added" or k in BASE))) for k in KINDS]
    return df.select("doc_id", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"))
