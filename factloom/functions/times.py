"""Times in free text, in two languages, as spans of days.

A text is a list of parts, a part is a period or a range of two, and a period is a day, a month, a season, a year, a decade,
a piece of one of these, or now; words before it make it a bound or an estimate. Spans that overlap or adjoin are merged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How names of months begin, in the order of the year.
MONTHS = [
    ("янв", "jan"),
    ("фев", "feb"),
    ("мар", "mar"),
    ("апр", "apr"),
    ("ма[йяе]", "may"),
    ("июн", "jun"),
    ("июл", "jul"),
    ("авг", "aug"),
    ("сен", "sep"),
    ("окт", "oct"),
    ("ноя", "nov"),
    ("дек", "dec"),
]
#: Seasons with the month that they begin in; winter begins in the year that it is named after.
SEASONS = {
    "весн": 3,
    "spring": 3,
    "лет": 6,
    "summer": 6,
    "осен": 9,
    "autumn": 9,
    "fall": 9,
    "зим": 12,
    "winter": 12,
}
ABOUT = "около|примерно|приблизительно|about|around|circa|ca\\."
BEFORE = "раньше|ранее|до|к|before|until|till|by"
AFTER = "позже|после|начиная с|с|after|since|from"
STARTING = "начал[оае]|beginning|start|early"
MIDDLE = "середин[аыеу]|middle|mid"
ENDING = "кон(?:ец|ца|це|цу|цом)|end|late"
NOW = "сейчас|ныне|сегодня|(?:в |по )?настоящ(?:ее|ий) (?:время|момент)|(?:по )?наст\\.? ?вр(?:\\.|емя)|по сей день|now|present|today|currently|to date"

SPAN = "array<struct<first:date,last:date,precision:string,is_open:boolean>>"
#: Names of the groups of a period.
GROUPS = ["about", "before", "after", "starting", "middle", "ending", "day", "word", "year", "decade", "iso_year", "iso_month", "iso_day"]
_WORD = "[a-zа-яё]"
_PERIOD = (
    rf"^(~|(?:{ABOUT})(?!{_WORD}))?\s*(?:(?:(?:in|в|во)(?!{_WORD}))\s*)?(?:({BEFORE})(?!{_WORD})|({AFTER})(?!{_WORD}))?\s*(?:the\s+)?"
    rf"(?:(?:({STARTING})|({MIDDLE})|({ENDING}))(?!{_WORD}))?[\s-]*(?:of\s+)?(?:the\s+)?(?:(\d{{1,2}})\s+)?({_WORD}{{3,}})?\.?\s*(?:of\s+)?"
    r"(?:(\d{4})(k)?|(\d{4})\.(\d{2})(?:\.(\d{2}))?)$"
)


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _month(word: Column) -> Column:
    number = F.lit(None).cast("int")
    for k, names in enumerate(MONTHS, 1):
        number = F.when(word.rlike(f"^(?:{'|'.join(names)})"), k).otherwise(number)
    return number


def _season(word: Column) -> Column:
    number = F.lit(None).cast("int")
    for name, month in SEASONS.items():
        number = F.when(word.startswith(name), month).otherwise(number)
    return number


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def _period(text: Column) -> Column:
    """first, last, precision, bound (before, after or now) of one period; a null first and no bound where it is not read."""

    def read(g: Column) -> Column:
        group = lambda k: F.nullif(F.try_element_at(g, F.lit(k)), F.lit(""))
        fields = {name: group(k) for k, name in enumerate(GROUPS, 1)}
        word = fields["word"]
        named = _let(word, lambda w: F.struct(_month(w).alias("month"), _season(w).alias("season")))
        return F.struct(*(x.alias(name) for name, x in fields.items()), named["month"].alias("month"), named["season"].alias("season"))

    def dated(x: Column) -> Column:
        month = F.coalesce(x["iso_month"].try_cast("int"), x["month"])
        number, on_day = F.coalesce(x["year"], x["iso_year"]), F.coalesce(x["day"], x["iso_day"])
        known = number.isNotNull() & (x["word"].isNull() | x["month"].isNotNull() | x["season"].isNotNull()) & (x["day"].isNull() | x["month"].isNotNull())
        begin = F.when(known, _date(number, F.coalesce(month, x["season"], F.lit(1)), F.coalesce(on_day, F.lit("1"))))
        months = F.when(x["decade"].isNotNull(), 120).when(month.isNotNull(), 1).when(x["season"].isNotNull(), 3).otherwise(12)
        unit = F.when(on_day.isNotNull(), "day").when(x["decade"].isNotNull(), "decade").when(month.isNotNull(), "month").when(x["season"].isNotNull(), "season").otherwise("year")
        return F.struct(begin.alias("begin"), months.alias("months"), unit.alias("unit"), *(x[c].alias(c) for c in ("about", "before", "after", "starting", "middle", "ending")))

    def ended(x: Column) -> Column:
        end = F.when(x["unit"] == "day", x["begin"]).otherwise(F.date_sub(F.add_months(x["begin"], x["months"]), 1))
        return F.struct(end.alias("end"), F.floor((F.datediff(end, x["begin"]) + 1) / 3).cast("int").alias("third"), x.alias("of"))

    def spanned(x: Column) -> Column:
        of, third = x["of"], x["third"]  # a piece is a third of a period
        first = F.when(of["middle"].isNotNull(), F.date_add(of["begin"], third)).when(of["ending"].isNotNull(), F.date_sub(x["end"], third - 1)).otherwise(of["begin"])
        last = F.when(of["middle"].isNotNull(), F.date_sub(x["end"], third)).when(of["starting"].isNotNull(), F.date_add(of["begin"], third - 1)).otherwise(x["end"])
        now = text.rlike(f"^(?:{NOW})$")
        bound = F.when(now, "now").when(of["before"].isNotNull(), "before").when(of["after"].isNotNull(), "after")
        piece = F.coalesce(of["starting"], of["middle"], of["ending"]).isNotNull()
        precision = F.when(now, "now").when(bound.isNotNull(), "bound").when(of["about"].isNotNull(), "about").when(piece, "part").otherwise(of["unit"])
        return F.struct(first.alias("first"), last.alias("last"), precision.alias("precision"), bound.alias("bound"))

    groups = F.split(F.regexp_replace(text, _PERIOD, "#".join(f"${k}" for k in range(1, len(GROUPS) + 1))), "#")
    return _let(_let(_let(_let(groups, read), dated), ended), spanned)


def _span(part: Column) -> Column:
    """The span of a part, a period or two with a bar between; null where it is not read."""

    def joined(sides: Column) -> Column:
        one, two = sides[0], F.try_element_at(sides, F.lit(2))
        ends_now = F.coalesce(two["bound"], F.lit("")) == "now"
        bound = F.coalesce(one["bound"], F.lit(""))
        alone = F.when(
            one["first"].isNotNull() | (bound == "now"),
            F.struct(F.when(bound.isin("", "after"), one["first"]).alias("first"), F.when(bound.isin("", "before"), one["last"]).alias("last"), one["precision"].alias("precision"), (bound != "").alias("is_open")),
        )
        sound = one["first"].isNotNull() & bound.isin("", "after") & (ends_now | (two["first"].isNotNull() & F.coalesce(two["bound"], F.lit("before")).isin("before") & (one["first"] <= two["last"])))
        pair = F.when(sound, F.struct(one["first"].alias("first"), F.when(~ends_now, two["last"]).alias("last"), F.lit("range").alias("precision"), ends_now.alias("is_open")))
        return F.when(F.size(sides) == 1, alone).when(F.size(sides) == 2, pair)

    return _let(F.transform(F.split(part, r"\s*\|\s*"), lambda x: _let(F.trim(x), _period)), joined)


def when_parts(raw: Column) -> Column:
    """The parts of a text as an array: lower-cased, without words for year, ranges written with a bar between their ends."""
    text = F.lower(F.trim(raw))
    rules = [
        (r"[–—−]", "-"),
        (r"[\s\x{A0}\x{2009}\x{202F}]+", " "),
        (r"(?<!\d)(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(?!\d)", "$1.$2.$3"),
        (r"(?<!\d)(\d{4})-(0[1-9]|1[0-2])(?![\d-])", "$1.$2"),
        (r"(?<!\d)(\d{3}0)(?:-?е|-?х|'?s)(?![a-zа-яё])(?: год(?:ы|ов|ах))?", "$1k"),
        (r"(\d{4}k?)\s*(?:гг\.?|г\.?|год(?:а|у|ом|ы|ов)?)(?![a-zа-яё])", "$1"),
        (r"^не (?:указан|извест|дан)[а-я]*$|^нет данных$|^not (?:given|known|stated|specified)$|^unknown$|^n/a$", ""),
        (rf"(?<![a-zа-яё])(?:с|from|between) ([^,;]*?\d{{4}}k?(?:\.\d{{2}})*) (?:по|до|to|until|till|and) ((?:[^,;]*?\d{{4}})|(?:{NOW}))", "$1 | $2"),
        (rf"(\d{{4}}k?(?:\.\d{{2}})*) (?:по|to) (?={NOW})", "$1 | "),
        (r"(\d{4}k?(?:\.\d{2})*)\s*-\s*(?=\S)", "$1 | "),
    ]
    for pattern, written in rules:
        text = F.regexp_replace(text, pattern, written)
    return F.filter(F.transform(F.split(text, r"\s*(?:[,;]| and | и )\s*"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def when_spans(raw: Column) -> Column:
    """The spans of days that a text means, sorted and merged: an array of (first, last, precision, is_open).

    Null first or last is an open end; precision is day, month, season, part (beginning, middle or end of a period), year,
    decade, about, bound, now or range, and of merged spans ranges. Null if any part of the text is not read (relative
    words, a month without a year), an empty array if the text says that nothing is known.
    """
    far = F.lit("9999-12-31").cast("date")
    early = F.lit("0001-01-01").cast("date")

    def fold(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        meets = x["a"] <= F.date_add(F.coalesce(last["last"], F.lit("9999-12-30").cast("date")), 1)
        both = F.struct(last["first"].alias("first"), F.when(last["last"].isNotNull() & x["span"]["last"].isNotNull(), F.greatest(last["last"], x["span"]["last"])).alias("last"), F.lit("ranges").alias("precision"), (last["is_open"] | x["span"]["is_open"]).alias("is_open"))
        more = F.array(x["span"])
        return F.when(F.size(done) == 0, more.cast(SPAN)).when(meets, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both)).cast(SPAN)).otherwise(F.concat(done, more).cast(SPAN))

    def merged(spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda x: F.struct(F.coalesce(x["first"], early).alias("a"), F.coalesce(x["last"], far).alias("b"), x.alias("span"))))
        return F.when(F.forall(spans, lambda x: x.isNotNull()), F.aggregate(ordered, F.array().cast(SPAN), fold))

    return _let(F.transform(when_parts(raw), _span), merged)


def parse_when(raw: Column) -> Column:
    """A struct of the raw text, first and last year, precision and whether an end is open; nulls where unsure.

    A text of several spans has the first year of the first and the last year of the last.
    """
    spans = when_spans(raw)

    def summed(spans: Column) -> Column:
        one, last = F.try_element_at(spans, F.lit(1)), F.try_element_at(spans, F.lit(-1))
        precision = F.when(F.size(spans) > 1, "ranges").otherwise(one["precision"])
        is_open = F.coalesce(F.exists(spans, lambda x: x["is_open"]), F.lit(False))
        return F.struct(raw.alias("raw"), F.year(one["first"]).alias("first_year"), F.year(last["last"]).alias("last_year"), precision.alias("precision"), is_open.alias("is_open"))

    return F.when(raw.isNull(), F.struct(raw.alias("raw"), *(F.lit(None).cast(k).alias(c) for c, k in (("first_year", "int"), ("last_year", "int"), ("precision", "string"), ("is_open", "boolean"))))).otherwise(_let(spans, summed))
