"""Words of texts as the lexical search counts them, and numbers as texts."""

from __future__ import annotations

import re

# The pattern of a token, and words that are left out.
TOKEN = r"[a-z0-9][a-z0-9'\-\.]*"
STOP_WORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "is", "are", "was", "were", "be", "been", "as", "at", "by", "that", "this", "it", "with", "from", "we", "our", "its", "their", "which", "such", "may", "will", "has", "have", "had", "not", "no", "but", "if", "than", "these", "those", "also"]
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_duck(text: str) -> str:
    """An array of the tokens of a text, in DuckDB."""
    return f"list_filter(regexp_extract_all(lower({text}), '{TOKEN.replace(chr(39), chr(39) * 2)}'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"


def tokens_spark(text: str) -> str:
    """The same in Spark; stop words are one set membership test a word."""
    return f"filter(regexp_extract_all(lower({text}), \"{TOKEN.replace(chr(92), chr(92) * 2)}\", 0), w -> length(w) > 1 AND w NOT IN ({_STOP}))"


def bigrams_spark(tokens: str) -> str:
    """Neighbouring tokens joined by an underscore."""
    return f"transform(slice({tokens}, 2, greatest(size({tokens}) - 1, 0)), (w, i) -> concat({tokens}[i], '_', w))"


def bigrams_duck(tokens: str) -> str:
    return f"list_transform(range(1, greatest(len({tokens}), 1)), lambda i: {tokens}[i] || '_' || {tokens}[i + 1])"


def _let(value: str, name: str, body: str) -> str:
    """``body`` of ``value``, which is computed once, in Spark."""
    return f"transform(array({value}), {name} -> {body})[0]"


def fixed_spark(value: str, places: int) -> str:
    """A number with ``places`` (0 to 6) digits after the point in Spark, as C and DuckDB print it.

    They round the double's exact value, ties to even; Spark's printf rounds its
    shortest decimal digits half up.  The part after the point is cut into halves of
    26 bits, so both products and the distance to the middle are exact.  Numbers of
    9e18 or more have no part after the point and are left to printf.
    """
    p = 10**places
    low = "(y.f - y.h)"
    n = f"floor(y.h * {p}e0 + {low} * {p}e0)"
    off = f"((y.h * {p}e0 - (n + 0.5e0)) + {low} * {p}e0)"
    units = _let(n, "n", f"CASE WHEN {off} > 0 OR ({off} = 0 AND (y.i % 2 * {p} + n) % 2 = 1) THEN n + 1 ELSE n END")
    digits = f"concat(CAST(y.i + r div {p} AS STRING), '.', lpad(CAST(r % {p} AS STRING), {places}, '0'))" if places else "CAST(y.i + r AS STRING)"
    split = "named_struct('i', floor(abs(x)), 'f', abs(x) - floor(abs(x)), 'h', (abs(x) - floor(abs(x))) * 134217729e0 - ((abs(x) - floor(abs(x))) * 134217729e0 - (abs(x) - floor(abs(x)))))"
    sign = "CASE WHEN startswith(CAST(x AS STRING), '-') THEN '-' ELSE '' END"
    plain = f"concat({sign}, {_let(split, 'y', _let(units, 'r', digits))})"
    return _let(f"CAST({value} AS DOUBLE)", "x", f"CASE WHEN x IS NULL THEN NULL WHEN isnan(x) THEN 'nan' WHEN abs(x) = double('infinity') THEN concat({sign}, 'inf') WHEN abs(x) >= 9e18 THEN printf('%.{places}f', x) ELSE {plain} END")


def printed_spark(sql: str) -> str:
    """DuckDB's printf of one number by ``fixed_spark``; the number is written without commas or brackets."""

    def spelled(found: re.Match) -> str:
        places, tail, value = found.groups()
        tail = tail.replace("%%", "%")
        return f"concat({fixed_spark(value, int(places))}, '{tail}')" if tail else fixed_spark(value, int(places))

    return re.sub(r"printf\('%\.(\d)f([^']*)', ([^(),]+)\)", spelled, sql)
