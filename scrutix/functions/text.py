"""Normalisation, tokens and per-document statistics as column expressions.

Everything is one projection: no shuffle, no Python but for NFKC on the rare
rows whose characters NFKC can change.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dialect as D
from . import lexicons as L

_FOLD_FROM = "".join(map(chr, L.EXOTIC_SPACES)) + "".join(chr(c) for c, _ in L.HOMOGLYPHS)
_FOLD_TO = " " * len(L.EXOTIC_SPACES) + "".join(a for _, a in L.HOMOGLYPHS)
_STRIP = "".join(map(chr, L.INVISIBLE + L.BIDI))


#: Runs of ASCII and plain Latin letters with marks; all that folding, evasion
#: counts, dashes and NFKC look for lies outside.
USUAL = r"[\x00-\x7F\xC0-\x{130}]+"


def unusual(c: Column) -> Column:
    """The characters of ``c`` that are neither ASCII nor plain Latin letters."""
    return F.when(F.length(c) == F.octet_length(c), F.lit("")).otherwise(F.regexp_replace(c, USUAL, ""))


def fold(c: Column, odd: Column | None = None) -> Column:
    """Fold exotic spaces and look-alikes, drop invisible and direction controls."""
    return F.when((unusual(c) if odd is None else odd) != "", F.translate(c, _FOLD_FROM + _STRIP, _FOLD_TO)).otherwise(c)


def _unstable_class() -> str:
    """Java class of the code points that NFKC can change or move."""
    spans: list[list[int]] = []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF or cp >= 0xF0000:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch) or not unicodedata.is_normalized("NFKC", ch) or 0x1160 <= cp <= 0x11FF or unicodedata.category(ch) in ("Mn", "Mc"):
            if spans and spans[-1][1] == cp - 1:
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans) + "]"


_unstable: list[str] = []


def nfkc(c: Column) -> Column:
    """NFKC; only rows with a character that it can change reach Python."""
    import pandas as pd

    if not _unstable:
        _unstable.append(_unstable_class())

    def normalize(s):
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    normalize.__annotations__ = {"s": pd.Series, "return": pd.Series}
    normalize = F.pandas_udf(normalize, "string")
    # the long class is tried on the few characters that may be in it
    return F.coalesce(normalize(F.when(unusual(c).rlike(_unstable[0]), c)), c)


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{D.S}+", " "))


def punctuate(c: Column, odd: Column | None = None) -> Column:
    """Plain quotes, and spaced hyphens for dashes."""
    return F.when((unusual(c) if odd is None else odd) != "", F.regexp_replace(F.translate(c, "".join(L.CURLY), "".join(L.CURLY.values())), "[—–]", " - ")).otherwise(c)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(D.WORD), F.lit(0))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, D.SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def lowered(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.lower(w))


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(terms) -> str:
    return ", ".join(map(quoted, terms))


def among(column: str, terms) -> Column:
    """The tokens of an array column that are in ``terms``, repeats included.

    Long lists are put as SQL text: one call builds the expression.
    """
    return F.expr(f"filter({column}, w -> w IN ({_listed(terms)}))")


def content(column: str, longer_than: int = 0) -> Column:
    """Tokens of an array column longer than a length that aren't stop words."""
    return F.expr(f"filter({column}, w -> length(w) > {longer_than} AND w NOT IN ({_listed(L.STOPWORDS)}))")


def frequent(s: Column, least) -> Column:
    """How many distinct tokens of a sorted array column occur at least ``least`` times.

    ``s`` must be a column: an expression would be sorted anew for each element.
    """
    least = F.lit(least) if isinstance(least, int) else least
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (F.get(s, i) == F.get(s, i + least - 1)) & ((i == 0) | (F.get(s, i - 1) != F.get(s, i))))
    return F.when(F.size(s) >= least, F.size(starts)).otherwise(0).cast("long")


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def occurrences(column: str, phrases) -> Column:
    """Non-overlapping occurrences in a string column, summed over phrases."""
    one = "if(contains({c}, {p}), cast((length({c}) - length(replace({c}, {p}, ''))) / {n} as int), 0)"
    return F.expr("cast(" + " + ".join(one.format(c=column, p=quoted(p), n=len(p)) for p in phrases) + " as bigint)")


def chars_of(c: Column, chars: str) -> Column:
    return (F.length(c) - F.length(F.translate(c, chars, ""))).cast("long")


def trigrams(tokens: Column) -> Column:
    """Runs of three tokens of an array column, joined."""
    n = F.size(tokens) - 2
    tail = lambda k: F.slice(tokens, k, F.greatest(n, F.lit(0)))
    pairs = F.zip_with(tail(1), tail(2), lambda a, b: F.concat(a, F.lit("\x01"), b))
    return F.when(n > 0, F.zip_with(pairs, tail(3), lambda a, b: F.concat(a, F.lit("\x01"), b))).otherwise(F.array().cast("array<string>"))


def mean_of(numbers: Column) -> Column:
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(numbers) > 0, total / F.size(numbers))


def burstiness(lengths: Column, mean: Column) -> Column:
    """Coefficient of variation of sentence lengths around ``mean``; -1 with fewer than five."""
    spread = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when((F.size(lengths) >= 5) & (mean > 0), F.sqrt(spread / F.size(lengths)) / mean).otherwise(-1.0)


def moving_ttr(tokens: str, window: int = 50) -> Column:
    """Mean share of distinct tokens over all windows of an array column; -1 for shorter texts.

    A token is new in the windows that start after its previous occurrence, so
    one pass over the sorted (token, place) pairs counts them all.
    """
    return F.expr(f"""
        if(size({tokens}) < {window}, -1D, aggregate(
            sort_array(transform({tokens}, (w, i) -> struct(w, i))),
            struct('' AS w, -1 AS i, 0L AS n),
            (a, x) -> struct(x.w AS w, x.i AS i, a.n + greatest(0, least(x.i, size({tokens}) - {window}) - greatest(if(a.i >= 0 AND a.w = x.w, a.i + 1, 0), x.i - {window - 1}, 0) + 1) AS n),
            a -> a.n / ((size({tokens}) - {window - 1}) * {float(window)}D)))""")


def mixed_script_words(c: Column, odd: Column) -> Column:
    """Words with letters of more than one of Latin, Greek and Cyrillic."""
    has = lambda w, x: F.when(w.rlike(x), 1).otherwise(0)
    tokens = F.regexp_extract_all(c, F.lit(f"{D.W}+"), F.lit(0))
    scripts = lambda w: has(w, r"[A-Za-z\x{C0}-\x{24F}&&\p{L}]") + has(w, r"[\x{370}-\x{3FF}\x{1F00}-\x{1FFF}&&\p{L}]") + has(w, r"[\x{400}-\x{52F}&&\p{L}]")
    suspect = odd.rlike(r"[\x{370}-\x{52F}\x{1F00}-\x{1FFF}]")
    return F.when(suspect, F.size(F.filter(tokens, lambda w: scripts(w) > 1))).otherwise(0).cast("long")


def evasion(c: Column, odd: Column | None = None) -> Column:
    """Struct of counts of character-level obfuscation in the raw text; ``odd``: its unusual characters."""
    c = F.coalesce(c, F.lit(""))
    odd = unusual(c) if odd is None else odd
    return F.struct(
        chars_of(odd, "".join(map(chr, L.INVISIBLE))).alias("invisible_chars"),
        chars_of(odd, "".join(map(chr, L.BIDI))).alias("bidi_controls"),
        chars_of(odd, "".join(map(chr, L.EXOTIC_SPACES))).alias("exotic_spaces"),
        chars_of(odd, "".join(chr(x) for x, _ in L.HOMOGLYPHS)).alias("confusable_chars"),
        mixed_script_words(c, odd).alias("mixed_script_words"),
    )


def _technical(item: Column) -> Column:
    return item.rlike(r"\p{Nd}") | (item.rlike(r"^\p{L}+$") & (item == F.upper(item)) & (F.length(item) <= 6))


def triads(c: Column) -> Column:
    """Rhetorical three-part lists, without technical enumerations."""
    found = F.regexp_extract_all(c, F.lit(D.TRIAD), F.lit(0))
    # a match by itself has the same groups
    plain = F.filter(found, lambda x: ~(_technical(F.regexp_extract(x, D.TRIAD, 1)) | _technical(F.regexp_extract(x, D.TRIAD, 2)) | _technical(F.regexp_extract(x, D.TRIAD, 3))))
    return F.when(F.contains(c, F.lit(",")), F.size(plain)).otherwise(0).cast("long")


def specificity(cased: Column, raw: Column) -> Column:
    """Share of concrete tokens and details, at most 1."""
    concrete = F.filter(cased, lambda w: w.rlike(r"[\p{Nd}]") | w.rlike(r"^\p{Lu}.*\p{Lu}"))
    total = F.size(concrete)
    for kind, (hint, pattern) in D.SPECIFIC.items():
        total = total + F.when(raw.rlike(hint), F.regexp_count(raw, F.lit(pattern))).otherwise(0)
    return F.when(F.size(cased) > 0, F.least(total / F.size(cased), F.lit(1.0))).otherwise(0.0)


def unsupported_sentences(s: Column, lower: Column) -> Column:
    """Sentences with a claim and no evidence in them or the next one."""
    terms = (*L.CLAIM_VERBS, *L.UNSUPPORTED_CLAIMS)
    claim = rf"(?iu){D.B}(?:{'|'.join(x.replace('-', chr(92) + '-') for x in terms)}){D.B}"
    bare = lambda x, i: x.rlike(claim) & ~F.concat_ws(" ", x, F.get(s, i + 1)).rlike(D.EVIDENCE)
    some = reduce(Column.__or__, (F.contains(lower, F.lit(t)) for t in terms))
    # letters with folds beyond what lower case shows
    return F.when(some | F.col("_norm").rlike("[\u0130\u0131\u017f\u212a]"), F.size(F.filter(s, bare))).otherwise(0).cast("long")


def sealed(df: DataFrame, columns) -> DataFrame:
    """``df`` with ``columns`` passed through a generator of one row.

    Spark neither merges projections through it nor pushes filters below it,
    so what the columns hold is written into the plan, and computed, once.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*(F.col(f"`{c}`") for c in kept), F.inline_outer(F.array(F.struct(*(F.col(c) for c in columns)))))


#: What ``with_text`` adds and the statistics read.
TEXT_COLUMNS = ("_raw", "_odd", "_norm", "_lower", "_sentences", "_tokens")


def with_text(df: DataFrame, text_col: str = "text", unicode_forms: bool = True, seal: bool = False) -> DataFrame:
    """Adds _raw, _odd (its unusual characters), _norm (cased), _lower, _sentences, _tokens (of each sentence), _cased and _words."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("_raw", raw)
    df = df.withColumn("_odd", unusual(F.col("_raw")))
    odd = F.col("_odd")
    folded = fold(F.col("_raw"), odd)
    df = df.withColumn("_norm", collapse(punctuate(nfkc(folded) if unicode_forms else folded, None if unicode_forms else odd)))
    df = df.withColumns({"_lower": F.lower("_norm"), "_sentences": sentences(F.col("_norm"))})
    # a word never crosses the end of a sentence
    df = df.withColumn("_tokens", F.transform("_sentences", lambda x: words(x)))
    if seal:
        df = sealed(df, TEXT_COLUMNS)
    df = df.withColumn("_cased", F.flatten("_tokens"))
    return df.withColumn("_words", lowered(F.col("_cased")))


#: The statistics that ``with_metrics`` adds.
METRICS = (
    "evasion", "word_count", "sentence_count", "avg_sentence_length", "link_count", "number_count", "citation_count", "dash_count", "transition_count",
    "claim_count", "repetition_count", "trigram_repeats", "repetition_density", "keyword_stuffing", "repeated_starts", "burstiness", "moving_ttr",
    "specificity_ratio", "contrast_count", "triad_count", "structure", "bare_claims", "evidence_density", "claim_density",
)


def with_metrics(df: DataFrame) -> DataFrame:
    """Adds the statistics (``METRICS``) of every document, all BIGINT, DOUBLE or structs of them."""
    s, raw, norm = F.col("_sentences"), F.col("_raw"), F.col("_norm")
    df = df.withColumns({"_lengths": F.transform("_tokens", lambda x: F.size(x)), "_content": content("_words"), "evasion": evasion(raw, F.col("_odd"))})
    df = df.withColumn("_long", F.filter("_content", lambda w: F.length(w) > 4))
    df = df.withColumn("_longer", F.filter("_long", lambda w: F.length(w) > 5))
    # the one letter whose lower case isn't a single letter takes the long way
    whole = F.transform(s, lambda x: F.slice(words(F.lower(x)), 1, 2))
    starters = F.when(F.contains(norm, F.lit("\u0130")), whole).otherwise(F.transform("_tokens", lambda x: F.transform(F.slice(x, 1, 2), lambda w: F.lower(w))))
    starters = F.filter(starters, lambda t: F.size(t) >= 2)
    # arrays that lambdas index must be columns of their own
    df = df.withColumns({"_mean_length": mean_of(F.col("_lengths")), "_s_long": F.sort_array("_long"), "_s_longer": F.sort_array("_longer"), "_s_tri": F.sort_array(trigrams(F.col("_content"))), "_s_start": F.sort_array(F.transform(starters, lambda t: F.array_join(t, " ")))})
    n = F.size("_words").cast("long")
    longs, longer = F.col("_long"), F.col("_longer")
    within = lambda sign, c, pattern: F.when(F.contains(F.lower(c), F.lit(sign)), count(c, pattern)).otherwise(0).cast("long")
    structure = F.struct(count(raw, D.MD_HEADER).alias("headers"), count(raw, D.MD_BOLD).alias("bold_runs"), count(raw, D.EMOJI_BULLET).alias("emoji_bullets"))
    return df.withColumns(
        {
            "word_count": n,
            "sentence_count": F.size("_sentences").cast("long"),
            "avg_sentence_length": F.coalesce(F.col("_mean_length"), F.lit(0.0)),
            "link_count": F.when(F.contains(F.lower(raw), F.lit("http")) | F.contains(F.lower(raw), F.lit("www.")), count(raw, D.LINK)).otherwise(0).cast("long"),
            "number_count": count(raw, D.NUMBER),
            "citation_count": F.when(raw.rlike(D.CITATION_HINT), count(raw, D.CITATION)).otherwise(0).cast("long"),
            "dash_count": chars_of(F.col("_odd"), "—–"),
            "transition_count": F.size(among("_words", L.TRANSITIONS)).cast("long"),
            "claim_count": F.size(among("_words", L.CLAIM_VERBS + L.UNSUPPORTED_CLAIMS)).cast("long"),
            "repetition_count": frequent(F.col("_s_long"), 4),
            "trigram_repeats": F.when(F.size("_content") >= 9, frequent(F.col("_s_tri"), 3)).otherwise(0),
            "repetition_density": F.when(F.size(longs) > 0, (F.size(longs) - F.size(F.array_distinct(longs))) / F.size(longs)).otherwise(0.0),
            "keyword_stuffing": F.when(F.size(longer) >= 40, frequent(F.col("_s_longer"), F.greatest(F.lit(5), F.floor((F.size(longer) + 19) / 20).cast("int")))).otherwise(0),
            "repeated_starts": F.when(F.size("_sentences") >= 4, frequent(F.col("_s_start"), 3)).otherwise(0),
            "burstiness": burstiness(F.col("_lengths"), F.col("_mean_length")),
            "moving_ttr": moving_ttr("_content"),
            "specificity_ratio": specificity(F.col("_cased"), raw),
            "contrast_count": within("not", norm, D.NOT_ONLY) + within("not", norm, D.NOT_DASH),
            "triad_count": triads(norm),
            "structure": structure,
            "bare_claims": unsupported_sentences(s, F.col("_lower")),
        }
    ).withColumns(
        {
            "evidence_density": F.when(n > 0, (F.col("link_count") + F.col("number_count") + F.col("citation_count")) / n).otherwise(0.0),
            "claim_density": F.when(n > 0, F.col("claim_count") / n).otherwise(0.0),
        }
    )
