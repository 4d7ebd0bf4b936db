"""Amounts in free text: one number with its scale, unit and currency, or nothing where that is not sure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How scale words begin, and signs and beginnings of words of currencies.
SCALES = {
    "тыс": 1_000,
    "thousand": 1_000,
    "млн": 1_000_000,
    "миллион": 1_000_000,
    "million": 1_000_000,
    "млрд": 1_000_000_000,
    "миллиард": 1_000_000_000,
    "billion": 1_000_000_000,
}
CURRENCIES = {
    "$": "USD",
    "долл": "USD",
    "usd": "USD",
    "€": "EUR",
    "евро": "EUR",
    "eur": "EUR",
    "₴": "UAH",
    "грив": "UAH",
    "грн": "UAH",
    "uah": "UAH",
    "₽": "RUB",
    "руб": "RUB",
    "rub": "RUB",
}
#: A number with digits in groups of three, or with a fraction, or both. The blanks in groups may be narrow or fixed.
GROUPED = r"\d{1,3}(?:(?<part>[\x{20}\x{A0}\x{2009}\x{202F}'])\d{3}(?:\k<part>\d{3})*(?:[.,]\d+)?|(?:,\d{3}){2,}(?:\.\d+)?|(?:\.\d{3}){2,}(?:,\d+)?|,\d{3}\.\d+|\.\d{3},\d+)(?!\d)"
PLAIN = r"\d+(?:[.,]\d+)?"
#: One group after one comma or point may be thousands or a fraction.
UNSURE = r"^\d{1,3}[.,]\d{3}$"


def parse_amount(raw: Column) -> Column:
    """A struct of the raw text, value, unit (percent, currency or number) and currency; nulls where unsure.

    Digits may be in groups of three. A text with several numbers (a range, say) has no value, nor has one number in which a comma
    or point before three digits may part thousands or a fraction; after a dollar sign a comma parts thousands.
    """
    text = F.lower(F.trim(raw))
    numbers = F.regexp_extract_all(text, F.lit(f"({GROUPED}|{PLAIN})"), F.lit(1))
    found = F.when(F.size(numbers) == 1, F.element_at(numbers, 1))
    dollars = text.rlike(r"\$\s*\d{1,3},\d{3}(?![\d.,])")
    found = F.when(found.rlike(UNSURE), F.when(dollars, F.replace(found, F.lit(","), F.lit("")))).otherwise(found)
    bare = F.regexp_replace(found, r"[\x{20}\x{A0}\x{2009}\x{202F}']", "")
    last = F.regexp_extract(bare, r"^.*([.,])", 1)  # what stands last parts the fraction, unless it stands more than once
    times = F.length(bare) - F.length(F.replace(bare, last, F.lit("")))
    whole = F.translate(bare, ".,", "")
    fraction = F.regexp_extract(bare, r"[.,](\d+)$", 1)
    number = F.when((last == "") | (times > 1), whole).otherwise(F.concat(F.substr(whole, F.lit(1), F.length(whole) - F.length(fraction)), F.lit("."), fraction))
    scale = F.lit(1)
    for word, factor in SCALES.items():
        scale = F.when(text.rlike(rf"\d\s*{word}"), F.lit(factor)).otherwise(scale)
    currency = F.lit(None).cast("string")
    for sign, code in CURRENCIES.items():
        currency = F.when(F.contains(text, F.lit(sign)), F.lit(code)).otherwise(currency)
    value = (number.try_cast("decimal(20,4)") * scale).cast("decimal(20,4)")
    unit = F.when(value.isNull(), None).when(F.contains(text, F.lit("%")), "percent").when(currency.isNotNull(), "currency").otherwise("number")
    return F.struct(raw.alias("raw"), value.alias("value"), unit.alias("unit"), F.when(value.isNotNull(), currency).alias("currency"))
