"""Column functions: numbers, prices, names, texts."""

from __future__ import annotations

import unicodedata
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words of true and false in JSON texts.
TRUE, FALSE = ("true", "1", "on", "yes"), ("false", "0", "off", "no")
INTEGERS = {"i32": (-(1 << 31), (1 << 31) - 1), "i64": (-(1 << 63), (1 << 63) - 1), "u32": (0, (1 << 32) - 1), "u64": (0, (1 << 64) - 1)}


def _try(c: Column, kind: str) -> Column:
    return c.try_cast(kind)


def lossy_number(text: Column) -> Column:
    """A JSON number or numeric text as a double, anything else 0."""
    return F.coalesce(_try(F.trim(text), "double"), F.lit(0.0))


def json_kind(value: Column) -> Column:
    """Of a variant: null, integer, number, string, boolean, array or object."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None).when(kind == "VOID", "null").when(kind == "BIGINT", "integer").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "number")
        .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").otherwise("object")
    )


def strict_cast(value: Column, to: str) -> Column:
    """A variant as `to` (u32, u64, i32, i64, f32, f64, string, bool), null where that fails.

    Integers take integral numbers and integer texts, both within range; texts are trimmed. Numbers take numbers, numeric
    texts and booleans. bool takes booleans, numbers (not 0 is true), the words of TRUE and FALSE, and null as false.
    string takes all, null as "null". Unsigned 64-bit values are decimals.
    """
    kind, text = json_kind(value), F.trim(F.try_variant_get(value, "$", "string"))
    if to in INTEGERS:
        low, high = INTEGERS[to]
        whole = F.when(kind.isin("integer", "string") | ((kind == "number") & text.rlike(r"^-?\d+$")), F.when(text.rlike(r"^[+-]?\d{1,20}$"), _try(text, "decimal(20,0)"))).when(kind == "boolean", (text == "true").cast("decimal(20,0)"))
        kept = F.when(whole.between(F.lit(str(low)).cast("decimal(20,0)"), F.lit(str(high)).cast("decimal(20,0)")), whole)
        return kept if to == "u64" else kept.cast({"i32": "int"}.get(to, "bigint"))
    if to in ("f32", "f64"):
        number = F.when(kind == "boolean", (text == "true").cast("int").cast("double")).when(kind.isin("integer", "number", "string"), _try(text, "double"))
        return number.cast("float") if to == "f32" else number
    if to == "bool":
        word = F.lower(text)
        said = F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)
        return F.when(kind == "null", False).when(kind == "boolean", text == "true").when(kind.isin("integer", "number"), _try(text, "double") != 0).when(kind == "string", said)
    if to == "string":
        return F.when(kind == "null", "null").when(kind == "string", F.try_variant_get(value, "$", "string")).when(kind.isNotNull(), F.to_json(value))
    raise ValueError(f"no type {to}")


def epoch_seconds(t: Column, provider: Column) -> Column:
    """Vendor times as seconds: one vendor gives milliseconds."""
    return F.when(provider == "binance", F.floor(t / 1000)).otherwise(t)


def price_digits(text: Column, empty: int | None = None, zero_is_null: bool = False) -> Column:
    """The digits of a price as a number; without digits `empty`."""
    value = _try(F.regexp_replace(text, "[^0-9]", ""), "bigint")
    value = F.nullif(value, F.lit(0).cast("bigint")) if zero_is_null else value
    return F.coalesce(value, F.lit(empty).cast("bigint")) if empty is not None else value


def price_scale(value: Column, rule: Column) -> Column:
    """A price in full by its shop's rule: `always` times 1000, `below N` times 1000 where it is less, else as it is."""
    limit = _try(F.regexp_extract(rule, r"^below (\d+)$", 1), "bigint")
    return F.when((rule == "always") | (value < limit), value * 1000).otherwise(value)


def clean_name(name: Column, group: Column | None = None, purity: Column | None = None) -> Column:
    """A product name in one form: no-break spaces and slashes are spaces, `(lần N)` and a leading dash go, group before, purity behind."""
    s = F.translate(name, "\u00a0/", "  ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?iu)\(\s*lần\s*\d+\s*\)", " "), r"^\s*-\s+", "")
    return F.concat_ws(" ", group, F.trim(F.regexp_replace(s, r"\s+", " ")), purity) if group is not None or purity is not None else F.trim(F.regexp_replace(s, r"\s+", " "))


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition, which Spark has no function for."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text)


def repaired(text: Column) -> Column:
    """Text whose UTF-8 was read as Latin-1, read right; other text as it is."""
    raw = F.encode(text, "ISO-8859-1")
    again = F.try_validate_utf8(raw.cast("string")) if hasattr(F, "try_validate_utf8") else F.decode(raw, "UTF-8")
    return F.when(text.rlike(r"[^\x00-\xFF]"), text).otherwise(F.coalesce(again, text))


def repaired_json(text: Column) -> Column:
    r"""JSON text with invalid escapes mended: \xNN becomes \u00NN, a backslash before anything else that JSON doesn't know goes."""
    return F.regexp_replace(F.regexp_replace(text, r"\\x([0-9A-Fa-f]{2})", r"\\u00$1"), r"\\(?![\"\\/bfnrtu])", "")


def _tones() -> tuple[str, str]:
    """Letters with marks, and the letters below them, of the Latin blocks that Vietnamese uses, by decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for block in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(*block)]
    pairs = [(a, b) for a, b in pairs if a != b] + [("đ", "d"), ("Đ", "D")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def remove_tones(text: Column) -> Column:
    """Text without marks on letters and without combining marks, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, *_tones()), r"\p{M}", ""))


def diff_text(diff: Column, degree: float = 1.0) -> Column:
    d = diff / float(degree)
    mark = F.when(d > 0, "▲").when(d < 0, "▼").otherwise("●")
    return F.when(d.isNotNull(), F.format_string("%s %.2f", mark, F.abs(d)))


def trend_text(first: Column, last: Column) -> Column:
    pct = (last - first) / first * 100
    return F.when(first.isNull() | last.isNull() | (first == 0), "0%").otherwise(F.format_string("%+.1f%%", pct))


def pct_from_diff(diff: Column, current: Column) -> Column:
    """Percent of a signed difference text and the current value against the value before; 0% where that isn't over 0 or unknown."""
    number = _try(F.regexp_replace(diff, r"[^0-9.\-]", ""), "double")
    down = diff.startswith("▼") & (number > 0)
    d = F.when(down, -number).otherwise(number)
    before = current - d
    return F.when(d.isNull() | (before <= 0) | before.isNull(), "0%").otherwise(F.format_string("%.2f%%", d / before * 100))


def money(value: Column, decimals: int = 0) -> Column:
    """Vietnamese format: dots by thousands, a decimal comma; a dash where it is missing."""
    return F.coalesce(F.translate(F.format_number(value, decimals), ",.", ".,"), F.lit("—"))


def short_volume(value: Column) -> Column:
    return F.when(value.isNull(), "---").when(value >= 1e6, F.format_string("%.2fM", value / 1e6)).when(value >= 1e3, F.format_string("%.2fK", value / 1e3)).otherwise(F.format_string("%.2f", value))


def resolution_hours(resolution: Column) -> Column:
    """Hours of a resolution: minutes `m`, hours `H`, days `d`; anything else is 1, `1D` too."""
    n, unit = _try(F.regexp_extract(resolution, r"^(\d+)([mHdWM])$", 1), "double"), F.regexp_extract(resolution, r"^(\d+)([mHdWM])$", 2)
    return F.when(unit == "m", n / 60).when(unit == "H", n).when(unit == "d", n * 24).otherwise(1.0)


def split_list(text: Column) -> Column:
    return F.array_sort(F.transform(F.split(text, ","), lambda x: F.trim(x)))


def split_scopes(text: Column) -> Column:
    """A comma list as integers, null where an element is none."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def delta_key(cell: Column, futures: Column) -> tuple[Column, Column]:
    """Symbol and column of a board's cell id: futures have 9 characters, stocks 3 in ids of under 8, else 8."""
    n = F.when(futures, 9).when(F.length(cell) < 8, 3).otherwise(8)
    return F.substring(cell, F.lit(1), n), F.substring(cell, n + 1, F.length(cell))


def delta_value(text: Column) -> Column:
    """The number in a cell's text: digits, point and minus; none is 0; null where they make no number."""
    kept = F.regexp_replace(text, r"[^0-9.\-]", "")
    return F.when(kept == "", 0.0).otherwise(_try(kept, "double"))


def valid_price_row(name: Column, buy: Column, sell: Column, rule: Column) -> Column:
    """Whether a scraped row counts by its shop's rule: `either` price there, `positive`: one over 0, `both`: both there; never without a name."""
    named = F.coalesce(F.trim(name) != "", F.lit(False)) & ~F.lower(name).rlike("khuyến mãi|loại vàng|giá vàng hôm nay")
    priced = F.when(rule == "both", buy.isNotNull() & sell.isNotNull()).when(rule == "positive", F.coalesce(F.greatest(buy, sell) > 0, F.lit(False))).otherwise(F.coalesce(buy, sell).isNotNull())
    return named & priced

