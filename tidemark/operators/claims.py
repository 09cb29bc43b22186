"""Numeric claims of texts, their grounding in evidence and passages, and a report on each text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds of numbers, most specific first (a number is claimed once); scales of their words; breaks of clauses and sentences.
PATTERNS = [
    ("usd_scaled", r"\$\s?(-?\d[\d,]*\.?\d*)\s*(billion|bn|million|mm|m|thousand|k|trillion)\b", re.I),
    ("usd", r"\$\s?(-?\d[\d,]*\.?\d*)", 0),
    ("pp", r"(-?\d[\d,]*\.?\d*)\s*(?:percentage points?|pp)\b", re.I),
    ("bps", r"(-?\d[\d,]*\.?\d*)\s*(?:bps|basis points)\b", re.I),
    ("percent", r"(-?\d[\d,]*\.?\d*)\s?%", 0),
    ("multiple", r"(-?\d[\d,]*\.?\d*)\s?x\b", re.I),
    ("days", r"(-?\d[\d,]*\.?\d*)\s*days\b", re.I),
]
SCALES = {"trillion": 1e12, "billion": 1e9, "bn": 1e9, "million": 1e6, "mm": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}
NOT_MONEY = re.compile(r"(19|20)\d{2}|\bQ[1-4]\b|\bFY\b|\bitem\b|\bpage\b", re.I)
SENTENCE, CLAUSE, CITED = ".!?;\n", ".!?;,\n", r"\[(C\d+)\]"
# Phrases that name a metric beside its label's words, and label words that name none.
PHRASES = {
    "debt_to_ebitda": ["gross leverage", "leverage ratio", "debt to ebitda", "debt/ebitda", "leverage stands", "leverage of", "leverage was", "leverage is", "leverage rose", "leverage fell"],
    "net_debt_to_ebitda": ["net leverage", "net debt to ebitda", "net debt/ebitda"],
    "ebitda_interest_coverage": ["interest coverage", "coverage ratio", "covered interest", "ebitda coverage"],
    "ebit_interest_coverage": ["ebit coverage", "ebit interest"],
    "fcf_interest_coverage": ["fcf coverage", "free cash flow coverage"],
    "current_ratio": ["current ratio"],
    "quick_ratio": ["quick ratio", "acid test"],
    "cash_ratio": ["cash ratio"],
    "cash_to_debt": ["cash to debt", "cash/debt"],
    "operating_margin": ["operating margin"],
    "gross_margin": ["gross margin"],
    "ebitda_margin": ["ebitda margin"],
    "net_margin": ["net margin", "profit margin"],
    "fcf_margin": ["free cash flow margin", "fcf margin"],
    "cfo_to_debt": ["cash flow to debt", "cfo to debt", "cfo/debt"],
    "return_on_assets": ["return on assets", "roa"],
    "return_on_equity": ["return on equity", "roe"],
    "debt_to_equity": ["debt to equity", "debt/equity", "gearing"],
    "debt_to_capital": ["debt to capital", "debt/capital"],
}
LABEL_STOP = ["the", "of", "and", "to", "a", "in", "per", "over", "from", "change", "total", "ttm", "fy", "q1", "q2", "q3", "q4", "window", "score"]
# Fewest and most words of a quoted phrase, and its least characters.
PHRASE_WORDS, PHRASE_CHARS = (4, 6), 12
# Per cent within which a claim is verified, and within which it contradicts; affinity that names a metric.
VERIFIED, NEAR, NAMED = 0.5, 25.0, 2
_COMPILED = [(kind, re.compile(p, flags)) for kind, p, flags in PATTERNS]


class Claim(NamedTuple):
    at: int
    claim: str
    value: float
    unit: str
    tolerance: float
    sentence: str
    clause: str
    context: str


def half_ulp(digits: str) -> float:
    """Half a unit of the last written place."""
    return 0.5 * 10.0 ** -len(digits.partition(".")[2]) if "." in digits else 0.5


def _between(text: str, start: int, end: int, breaks: str) -> str:
    left = max(text.rfind(b, 0, start) for b in breaks) + 1
    rights = [p for b in breaks if (p := text.find(b, end)) >= 0]
    return " ".join(text[left : min(rights, default=len(text))].split())


def extract(text: str | None) -> Iterator[Claim]:
    """Claims in the order of the patterns, then of the text; null has none."""
    text = text or ""
    taken: list[tuple[int, int]] = []
    for kind, pattern in _COMPILED:
        for m in pattern.finditer(text):
            a, b = m.span()
            if any(a < e and s < b for s, e in taken):
                continue
            digits = m[1].replace(",", "")
            if kind == "usd" and NOT_MONEY.search(m[0]):
                continue
            scale = SCALES[m[2].lower()] if kind == "usd_scaled" else 1.0
            taken.append((a, b))
            context = text[max(0, a - 90) : b + 60].replace("\n", " ").strip()
            yield Claim(a, m[0].strip(), float(digits) * scale, "USD" if kind.startswith("usd") else kind, half_ulp(digits) * scale, _between(text, a, b, SENTENCE), _between(text, a, b, CLAUSE), context)


def claims(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, at, claim, value, unit, tolerance, sentence, clause, context) of all texts."""
    kind = dict(texts.dtypes)[key]

    def run(batches):
        for batch in batches:
            rows = [(k, i, *c) for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True) for i, c in enumerate(extract(t))]
            if rows:
                keys, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), *map(pa.array, rest)], names=[key, "ordinal", *Claim._fields])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, ordinal long, at long, claim string, value double, unit string, tolerance double, sentence string, clause string, context string")


def compatible(claimed: Column, held: Column) -> Column:
    plain = ["multiple", "x", "score", ""]
    return (claimed == held) | (claimed.isin("pp", "bps") & held.isin("%", "pp")) | ((claimed == "percent") & (held == "%")) | (claimed.isin(plain) & held.isin(plain))


def affinity(scope: Column, key: Column, label: Column, ticker: Column) -> Column:
    """2 for a phrase of the metric, 1 for each word of its label and 1 for its issuer that the scope holds."""
    lowered = F.lower(scope)
    metric = F.element_at(F.split(key, ":"), -1)
    named = F.coalesce(F.create_map(*[x for k, ps in PHRASES.items() for x in (F.lit(k), F.array(*map(F.lit, ps)))])[metric], F.array().cast("array<string>"))
    words = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(label), F.lit("[a-z]{3,}"), F.lit(0))), F.array(*map(F.lit, LABEL_STOP)))
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    return 2 * one(F.exists(named, lowered.contains)) + F.size(F.filter(words, lowered.contains)) + one((ticker != "") & lowered.contains(F.lower(ticker)))


def verify(found: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """``found`` claims with status, matched_key, matched_value and deviation.

    ``evidence`` has the text's key, evidence_key, label, value, unit, ticker and an
    ordinal ``place``; only a text's own evidence is compared, so the join is on the
    key and never all with all.
    """
    e = evidence.select(F.col(key).alias("__k"), "evidence_key", "label", F.col("value").alias("held"), F.col("unit").alias("held_unit"), "ticker", "place")
    pairs = found.join(e, F.col(key) == F.col("__k"), "left")
    of = Window.partitionBy(key, "ordinal")
    pairs = pairs.withColumn("__c", affinity(F.col("clause"), F.col("evidence_key"), F.col("label"), F.col("ticker"))).withColumn("__s", affinity(F.col("sentence"), F.col("evidence_key"), F.col("label"), F.col("ticker")))
    pairs = pairs.withColumn("__cm", F.max("__c").over(of)).withColumn("__sm", F.max("__s").over(of))
    pool = F.when(F.col("__cm") >= NAMED, F.col("__c") == F.col("__cm")).when(F.col("__sm") >= NAMED, F.col("__s") == F.col("__sm")).otherwise(True)
    held = F.col("held")
    variants = F.when(F.col("held_unit") == "USD", F.array(held, held * 1e6, held * 1e9)).when(F.col("held_unit").isin("%", "pp"), F.array(held, held * 100)).otherwise(F.array(held))

    def near(c: Column, i: Column) -> Column:
        gap = F.abs(F.col("value") - c)
        off = F.when(gap <= F.col("tolerance") * (1 + 1e-9) + 1e-12, 0.0).when(c != 0, F.try_divide(gap, F.abs(c)) * 100)
        return F.struct(off.alias("off"), F.col("place").alias("place"), i.alias("i"), c.alias("value"), F.col("evidence_key").alias("key"))

    tried = F.when(pool & compatible(F.col("unit"), F.col("held_unit")) & held.isNotNull(), F.array_min(F.filter(F.transform(variants, near), lambda x: x["off"].isNotNull())))
    best = pairs.withColumn("__t", tried).groupBy(*[c for c in found.columns]).agg(F.min("__t").alias("__b"))
    off = F.col("__b.off")
    status = F.when(off <= VERIFIED, "verified").when(off <= NEAR, "contradicted").otherwise("unsupported")
    kept = off <= NEAR
    return best.select(*found.columns, status.alias("status"), F.when(kept, F.col("__b.key")).alias("matched_key"), F.when(kept, F.col("__b.value")).alias("matched_value"), F.when(kept, off).alias("deviation"))


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def ledger(seen: DataFrame, key: str, chunk: str, turn: str) -> DataFrame:
    """(key, chunk, label): each chunk that a text was given, once, as C1, C2, ... in the order in which it was first seen."""
    first = seen.groupBy(key, chunk).agg(F.min(turn).alias("__t"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("__t", chunk))
    return first.select(key, chunk, F.concat(F.lit("C"), place.cast("string")).alias("label"))


def _phrases(before: Column, after: Column) -> Column:
    """The shortest phrase of PHRASE_WORDS words or more on each side of a number that is long enough; longer ones hold it."""

    def shortest(words: Column, take) -> Column:
        sizes = [(n, F.regexp_replace(F.array_join(take(words, n), " "), r"^[ .,;:]+|[ .,;:]+$", "")) for n in range(PHRASE_WORDS[0], PHRASE_WORDS[1] + 1)]
        return F.coalesce(*[F.when((F.size(words) >= n) & (F.length(p) >= PHRASE_CHARS), p) for n, p in sizes])

    right = shortest(after, lambda w, n: F.slice(w, 1, n))
    left = shortest(before, lambda w, n: F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n))
    return F.array_compact(F.array(right, left))


def _pairs(words: Column) -> Column:
    """Hashes of the neighbouring words of an array, each once."""
    return F.transform(F.array(words), lambda w: F.array_distinct(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), x))))[0]


def ground(checked: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """Claims not verified that a passage of the text's own quotes become 'cited', by the first such label.

    A passage quotes a claim if it holds the number and four to six words beside it,
    12 characters or longer, that stand on one side of the number in the claim's context.  Inner words
    of a phrase are whole words of the passage, so claims meet passages by the phrase's
    second and third word, within one text; only those that meet are read.  Case and
    white space do not count.  A phrase has four words besides marks that stand alone.
    """
    held = passages.select(F.col(key).alias("__k"), "label", _flat(F.col("text")).alias("__p"))
    index = held.select("__k", "label", F.explode(_pairs(_words(F.col("__p")))).alias("__g"))
    spoken, token = _flat(F.col("context")), F.trim(F.lower("claim"))
    at = F.instr(F.col("__c"), F.col("__n"))
    claims = checked.filter((F.col("status") != "verified") & (token != "")).select(F.col(key).alias("__k"), F.col("ordinal").alias("__o"), spoken.alias("__c"), token.alias("__n")).filter(at > 0)
    sides = _words(F.substring(F.col("__c"), F.lit(1), at - 1)), _words(F.substring(F.col("__c"), at + F.length("__n"), F.length("__c")))
    asked = claims.select("__k", "__o", "__n", F.explode(_phrases(*sides)).alias("__q")).withColumn("__w", _words(F.col("__q"))).filter(F.size("__w") >= PHRASE_WORDS[0])
    asked = asked.withColumn("__g", F.xxhash64(F.col("__w")[1], F.col("__w")[2])).drop("__w")
    met = asked.join(index, ["__k", "__g"]).join(held, ["__k", "label"]).filter(F.contains("__p", "__n") & F.contains("__p", "__q"))
    number = F.regexp_extract("label", r"(\d+)", 1).try_cast("int")
    first = met.groupBy("__k", "__o").agg(F.min(F.struct(number.alias("n"), "label"))["label"].alias("__l"))
    out = checked.join(first, (F.col(key) == F.col("__k")) & (F.col("ordinal") == F.col("__o")), "left")
    cited = F.col("__l").isNotNull()
    return out.withColumns({"status": F.when(cited, "cited").otherwise(F.col("status")), "matched_key": F.when(cited, F.col("__l")).otherwise(F.col("matched_key")), "matched_value": F.when(~cited, F.col("matched_value")), "deviation": F.when(~cited, F.col("deviation"))}).drop("__k", "__o", "__l")


def citations(texts: DataFrame, key: str, text: str, known: str, declared: str | None = None) -> DataFrame:
    """(key, valid, invalid, unused): labels that a text uses or declares against those it was given, in order of number."""
    used = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CITED), F.lit(1))
    if declared:
        used = F.array_union(used, F.filter(F.transform(F.coalesce(F.col(declared), F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != ""))
    by_number = lambda a: F.transform(F.array_sort(F.transform(F.array_distinct(a), lambda c: F.struct(F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("n"), c.alias("c")))), lambda s: s["c"])
    given = F.coalesce(F.col(known), F.array().cast("array<string>"))
    return texts.select(key, by_number(F.array_intersect(used, given)).alias("valid"), by_number(F.array_except(used, given)).alias("invalid"), by_number(F.array_except(given, used)).alias("unused"))


def report(counts: DataFrame) -> DataFrame:
    """Rates and confidence from verified, cited, unsupported, contradicted, valid, invalid, numbers, passages and stated (a word or null)."""
    n = F.col("verified") + F.col("cited") + F.col("unsupported") + F.col("contradicted")
    bad = F.coalesce(F.try_divide(F.col("unsupported") + F.col("contradicted"), n), F.lit(0.0))
    score = 2 - F.when(bad > 0.05, 1).otherwise(0) - F.when(F.col("numbers") < 4, 1).otherwise(0) - F.when(F.col("passages") < 3, 1).otherwise(0)
    rank = F.create_map(F.lit("low"), F.lit(0), F.lit("medium"), F.lit(1), F.lit("high"), F.lit(2))
    score = F.least(F.greatest(score, F.lit(0)), F.coalesce(rank[F.col("stated")], F.lit(2)))
    low = (F.col("contradicted") > 0) | (F.col("invalid") > 0) | (bad > 0.25)
    return counts.withColumns({
        "numeric_accuracy": F.coalesce(F.try_divide(F.col("verified") + F.col("cited"), n), F.lit(1.0)),
        "unsupported_rate": bad,
        "citation_validity": F.coalesce(F.try_divide(F.col("valid"), F.col("valid") + F.col("invalid")), F.lit(1.0)),
        "confidence": F.when(low, "low").otherwise(F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), score + 1)),
    })
