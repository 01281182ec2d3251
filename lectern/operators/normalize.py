"""Ordered rewrite rules that turn written forms into the words a reader would say.

The order of the rules is part of their meaning: every rule sees what those before it made. Each is a pattern and a
replacement that may look at the words around the match; None leaves the place as it is. One Arrow UDF runs the list, so a
text crosses from the JVM and back once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import DAYS, HUNDRED, IRREGULAR, MONTHS, ONES, ROMAN, SCALES

# --- words for numbers, as rules give them: no hyphens, commas or "and" ---


def number_words(n: int) -> str:
    if n < 0:
        return "minus " + number_words(-n)
    if n < 100:
        return HUNDRED[n].replace("-", " ")
    if n < 1000:
        return f"{ONES[n // 100]} hundred" + (f" {number_words(n % 100)}" if n % 100 else "")
    for value, name in SCALES:
        if n >= value:
            return f"{number_words(n // value)} {name}" + (f" {number_words(n % value)}" if n % value else "")
    raise AssertionError


def ordinal_words(n: int) -> str:
    head, space, last = number_words(n).rpartition(" ")
    return head + space + IRREGULAR.get(last, last.removesuffix("y") + ("ieth" if last.endswith("y") else "th"))


def year_words(n: int) -> str:
    high, low = divmod(n, 100)
    if high == 0 or high % 10 == 0 and low < 10 or high >= 100:
        return number_words(n)
    return f"{number_words(high)} " + ("hundred" if not low else f"oh {ONES[low]}" if low < 10 else number_words(low))


def digit_words(text: str) -> str:
    return " ".join("oh" if c == "0" else ONES[int(c)] for c in text if c.isdecimal())


def decimal_words(text: str) -> str:
    whole, _, part = text.replace(",", "").partition(".")
    return number_words(int(whole or 0)) + (f" point {' '.join(ONES[int(c)] for c in part)}" if part else "")


def roman_number(text: str) -> int | None:
    """The value of a canonical numeral."""
    n, rest = 0, text
    for value, sign in ROMAN:
        while rest.startswith(sign):
            n, rest = n + value, rest[len(sign) :]
    back, m = "", n
    for value, sign in ROMAN:
        while m >= value:
            back, m = back + sign, m - value
    return n if n and not rest and back == text else None


# --- dimensions; fixed values ---

CURRENCIES = {"$": ("dollar", "dollars", "cent", "cents"), "£": ("pound", "pounds", "penny", "pence"), "€": ("euro", "euros", "cent", "cents"), "¥": ("yen", "yen", "", "")}
MAGNITUDES = {"k": "thousand", "K": "thousand", "m": "million", "M": "million", "bn": "billion", "B": "billion", "tn": "trillion"}
UNITS = {
    "kg": ("kilogram", "kilograms"), "g": ("gram", "grams"), "mg": ("milligram", "milligrams"), "lb": ("pound", "pounds"), "lbs": ("pound", "pounds"), "oz": ("ounce", "ounces"),
    "km": ("kilometer", "kilometers"), "cm": ("centimeter", "centimeters"), "mm": ("millimeter", "millimeters"), "mi": ("mile", "miles"), "ft": ("foot", "feet"), "yd": ("yard", "yards"),
    "km/h": ("kilometer per hour", "kilometers per hour"), "mph": ("mile per hour", "miles per hour"), "ml": ("milliliter", "milliliters"), "L": ("liter", "liters"), "GB": ("gigabyte", "gigabytes"), "MB": ("megabyte", "megabytes"),
    "kWh": ("kilowatt hour", "kilowatt hours"), "Hz": ("hertz", "hertz"), "MHz": ("megahertz", "megahertz"), "hrs": ("hour", "hours"), "hr": ("hour", "hours"), "min": ("minute", "minutes"), "sec": ("second", "seconds"), "psi": ("P S I", "P S I"),
}
PER = {"mo": "month", "yr": "year", "hr": "hour", "h": "hour", "wk": "week", "day": "day", "night": "night", "person": "person", "month": "month", "year": "year"}
DAY_NAMES = {"Mon": "Monday", "Tue": "Tuesday", "Tues": "Tuesday", "Wed": "Wednesday", "Weds": "Wednesday", "Thu": "Thursday", "Thur": "Thursday", "Thurs": "Thursday", "Fri": "Friday", "Sat": "Saturday", "Sun": "Sunday"}
MONTH_NAMES = {m[:3]: m for m in MONTHS} | {"Sept": "September"} | {m: m for m in MONTHS}
TITLES = {"Dr": "Doctor", "Mr": "Mister", "Mrs": "Missus", "Prof": "Professor", "Gen": "General", "Col": "Colonel", "Capt": "Captain", "Lt": "Lieutenant", "Sgt": "Sergeant", "Maj": "Major", "Rev": "Reverend", "Sen": "Senator", "Rep": "Representative", "Gov": "Governor", "Pres": "President", "Hon": "Honorable"}
STREETS = {"Rd": "Road", "Ave": "Avenue", "Blvd": "Boulevard", "Ln": "Lane", "Ct": "Court", "Pl": "Place", "Pkwy": "Parkway", "Hwy": "Highway", "Sq": "Square", "Ter": "Terrace", "St": "Street", "Dr": "Drive"}
STATES = {"CA": "California", "NY": "New York", "TX": "Texas", "FL": "Florida", "WA": "Washington", "IL": "Illinois", "MA": "Massachusetts", "PA": "Pennsylvania", "OH": "Ohio", "GA": "Georgia", "DC": "D C"}
DIRECTIONS = {"N": "North", "S": "South", "E": "East", "W": "West", "NE": "Northeast", "NW": "Northwest", "SE": "Southeast", "SW": "Southwest"}
LABELS = {"p": "page", "pp": "pages", "Fig": "figure", "fig": "figure", "Vol": "volume", "vol": "volume", "Ch": "chapter", "ch": "chapter", "Sec": "section", "No": "number", "Nos": "numbers", "Art": "article"}
FRACTIONS = {"½": "one half", "⅓": "one third", "⅔": "two thirds", "¼": "one quarter", "¾": "three quarters", "⅛": "one eighth", "⅜": "three eighths", "⅝": "five eighths", "⅞": "seven eighths"}
NUMBERED = "Act Book Chapter Class Grade Level Part Phase Section Season Stage Tier Type Unit Volume Appendix Article Episode Mark Schedule Title".split()
SHORT = {"approx": "approximately", "avg": "average", "dept": "department", "est": "estimated", "govt": "government", "intl": "international", "max": "maximum", "min": "minimum", "misc": "miscellaneous", "incl": "including", "excl": "excluding", "esp": "especially"}

#: Rules no match of which is without a digit (of the match itself or beside it), marked by hand: texts without a digit skip
#: them. A rule left out here is only slower. "state and code" isn't one, as its code is optional.
NEED_DIGIT = frozenset((
    "quarter split", "money with magnitude", "money range", "money per unit", "money", "cents", "phone", "phone extension", "labelled digits",
    "street number", "suite", "height", "height in words", "size", "multiplier", "short year", "copyright", "number sign", "ISO date", "numeric date",
    "rate per time", "temperature", "degrees", "squared units", "compound duration", "ago", "about", "age", "blood pressure", "modifier with unit",
    "unit", "percent range", "percent", "day-first date", "month range of days", "month and day", "month and year", "time range", "clock", "century",
    "ratio", "rating", "mixed fraction", "fraction", "label before a number", "year range", "number range", "operators", "circa", "ordinal",
))

Reader = Callable[[re.Match, str, str], "str | None"]


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: re.Pattern
    read: Reader

    @property
    def needs_digit(self) -> bool:
        return self.name in NEED_DIGIT


RULES: list[Rule] = []


def rule(name: str, pattern: str, flags: int = 0):
    def register(read: Reader) -> Reader:
        RULES.append(Rule(name, re.compile(pattern, flags), read))
        return read

    return register


def fixed(name: str, pattern: str, by: str, flags: int = 0) -> None:
    RULES.append(Rule(name, re.compile(pattern, flags), lambda m, text, accent: m.expand(by)))


def _any(words) -> str:
    return "|".join(sorted(map(re.escape, words), key=lambda w: (-len(w), w)))


def _stop(m: re.Match, text: str) -> str:
    """The full stop of an abbreviation stays where it also ends the sentence."""
    after = text[m.end() :]
    return "." if m.group(0).endswith(".") and (not after.strip() or re.match(r"\s+[A-Z]", after)) else ""


_N = r"\d{1,3}(?:,\d{3})+|\d+"

fixed("quarter split", r"\b([QH][1-4])['’](\d\d)\b", r"\1 '\2")


@rule("money with magnitude", rf"([$£€¥])((?:{_N})(?:\.\d+)?) ?(k|K|m|M|bn|B|tn|thousand|million|billion|trillion)\b")
def _(m, text, accent):
    return f"{decimal_words(m[2])} {MAGNITUDES.get(m[3], m[3])} {CURRENCIES[m[1]][1]}"


@rule("money range", rf"([$£€])({_N})[–-]\1?({_N})(?![\d.])")
def _(m, text, accent):
    low, high = (int(x.replace(",", "")) for x in (m[2], m[3]))
    return f"{number_words(low)} to {number_words(high)} {CURRENCIES[m[1]][1]}" if low < high else None


@rule("money per unit", rf"([$£€])({_N})(?:\.(\d\d))?/(mo|yr|hr|h|wk|day|night|person|month|year)\b")
def _(m, text, accent):
    return f"{_amount(m[1], int(m[2].replace(',', '')), m[3])} {'a' if m[4] != 'h' and m[4] != 'hr' else 'an'} {PER[m[4]]}"


def _amount(sign: str, units: int, cents: str | None) -> str:
    one, many, cent, plural = CURRENCIES[sign]
    small = int(cents or 0)
    unit = one if units == 1 else many
    if not small or not cent:
        return f"{number_words(units)} {unit}"
    if not units:
        return f"{number_words(small)} {cent if small == 1 else plural}"
    if sign == "$" and units < 1000 and units % 100:
        return f"{number_words(units)} " + (f"oh {ONES[small]}" if small < 10 else number_words(small))
    if sign == "$":
        return f"{number_words(units)} {unit} and {number_words(small)} {cent if small == 1 else plural}"
    return f"{number_words(units)} {unit} {number_words(small)}"


@rule("money", rf"([$£€¥])({_N})(?:\.(\d\d?))?(?![\d.]*\d)")
def _(m, text, accent):
    return _amount(m[1], int(m[2].replace(",", "")), m[3] and m[3].ljust(2, "0"))


@rule("cents", r"\b(\d+) ?¢")
def _(m, text, accent):
    return f"{number_words(int(m[1]))} {'cent' if m[1] == '1' else 'cents'}"


@rule("phone", r"(?<![\d.-])(?:\+?1[ .-])?\(?([2-9]\d\d)\)?[ .-](\d{3})[.-](\d{4})(?![\d-])")
def _(m, text, accent):
    lead = "one, " if m[0].lstrip("+").startswith("1") else ""
    area = f"{ONES[int(m[1][0])]} hundred" if m[1].endswith("00") else digit_words(m[1])
    return f"{lead}{area}, {digit_words(m[2])}, {digit_words(m[3])}"


@rule("phone extension", r"\b(?:[Ee]xt\.?|x) ?(\d{2,5})\b")
def _(m, text, accent):
    return f"extension {digit_words(m[1])}"


@rule("labelled digits", r"\b(PIN|[Mm]eeting ID|passcode|ZIP(?: code)?):? (\d{3,}(?: \d{3,})*)")
def _(m, text, accent):
    return f"{m[1]} " + ", ".join(digit_words(g) for g in m[2].split())


@rule("state and code", rf"\b([A-Z][a-z]+), ({_any(STATES)})(?: (\d{{5}}))?\b")
def _(m, text, accent):
    return f"{m[1]}, {STATES[m[2]]}" + (f" {digit_words(m[3])}" if m[3] else "")


@rule("street number", rf"\b(\d{{3,5}}) ((?:{_any(DIRECTIONS)})\.? )?([A-Z][a-z]+(?: [A-Z][a-z]+)?) ({_any(STREETS)})\b\.?")
def _(m, text, accent):
    n = int(m[1])
    high, low = divmod(n, 100)
    number = number_words(n) if n >= 10_000 or high % 10 == 0 and n >= 1000 and not low else f"{number_words(high)} " + ("hundred" if not low else f"oh {ONES[low]}" if low < 10 else number_words(low))
    return f"{number} {DIRECTIONS[m[2].strip(' .')] + ' ' if m[2] else ''}{m[3]} {STREETS[m[4]]}{_stop(m, text)}"


fixed("post box", r"\bP\.?O\.? [Bb]ox\b", "P O Box")


@rule("suite", r"\b(Apt|Ste|Rm|Fl|Bldg)\. ?#?(\d+[A-Z]?)\b")
def _(m, text, accent):
    return f"{dict(Apt='apartment', Ste='suite', Rm='room', Fl='floor', Bldg='building')[m[1]]} {m[2]}"


@rule("saint", r"\bSt\.? (?=[A-Z][a-z]+)")
def _(m, text, accent):
    return None if re.search(r"\d\S* [A-Z]?[a-z]* ?$|[a-z] $", text[: m.start()]) and re.search(r"[A-Z][a-z]+ $", text[: m.start()]) else "Saint "


@rule("title before a name", rf"\b({_any(TITLES)})\. (?=[A-Z])")
def _(m, text, accent):
    return TITLES[m[1]] + " "


fixed("senior", r"\b(?:Sr|Snr)\.(?=\W|$)", "Senior")
fixed("junior", r"\bJr\.(?=\W|$)", "Junior")
fixed("esquire", r",? Esq\.", ", Esquire")
fixed("with", r"\bw/(?=[\s\w])(?!o\b|in\b)\s?", "with ")
fixed("without", r"\bw/o\b", "without")
fixed("within", r"\bw/in\b", "within")
fixed("because", r"\bb/c\b|(?<=\s)bc(?=\s[a-z])", "because")
fixed("care of", r"\bc/o\b", "care of")
fixed("for example", r"\be\.g\.,?", "for example,")
fixed("that is", r"\bi\.e\.,?", "that is,")
fixed("and so on", r"\betc\.(?=\s+[a-z,;)])", "et cetera")
fixed("and so on, at an end", r"\betc\.", "et cetera.")
fixed("plus or minus", r"\+/-|±", "plus or minus ")
fixed("retirement plan", r"\b401\(?k\)?", "four oh one K")


@rule("height", r"\b(\d)['′] ?(\d{1,2})[\"″]")
def _(m, text, accent):
    return f"{ONES[int(m[1])]} foot {number_words(int(m[2]))}"


@rule("height in words", r"\b(\d) ?ft\.? (\d{1,2}) ?in\b\.?")
def _(m, text, accent):
    return f"{ONES[int(m[1])]} foot {number_words(int(m[2]))}"


@rule("size", r"\b(\d+(?:\.\d+)?) ?[x×] ?(\d+(?:\.\d+)?)\b")
def _(m, text, accent):
    return f"{decimal_words(m[1])} by {decimal_words(m[2])}"


@rule("multiplier", r"\b(\d+)[x×](?=\s)")
def _(m, text, accent):
    return f"{number_words(int(m[1]))} times"


@rule("roman after a keyword", rf"\b({_any(NUMBERED)}|World War) ([IVXLC]+)\b")
def _(m, text, accent):
    n = roman_number(m[2])
    return None if n is None or n > 99 else f"{m[1]} {number_words(n)}"


@rule("roman of a person", r"\b(Henry|Louis|George|Elizabeth|Charles|Edward|James|William|Richard|Philip|Pius|John Paul) ([IVX]{1,5})\b(?!\.)")
def _(m, text, accent):
    n = roman_number(m[2])
    return None if n is None else f"{m[1]} the {ordinal_words(n)}"


fixed("minus sign", "−", "-")
fixed("wiki heading", r"(?m)^=+ *([^=\n]+?) *=+$", r"\1")
fixed("short year", r"(?<![\w'])['’]0(\d)\b", r"oh \1")
fixed("middle dot", r" · ", ", ")
fixed("silent marks", r"[™®]", "")
fixed("sections", r"§§ ?", "sections ")
fixed("section", r"§ ?", "section ")
fixed("paragraph", r"¶ ?", "paragraph ")
fixed("copyright", r"(?:©|\([cC]\)) ?(?=\d{4})", "copyright ")
fixed("per mille", r" ?‰", " per mille")
fixed("numero", r"№ ?|\bn° ?", "number ")
fixed("number sign", r"(?<!\S)#(?=\d)", "number ")


@rule("keys", r"\b(?:Ctrl|Cmd|Alt|Shift)(?:\+\w+)+")
def _(m, text, accent):
    return " ".join({"Ctrl": "control", "Cmd": "command"}.get(p, p) for p in m[0].split("+"))


def _date_words(day: int, month: int, year: int | None, accent: str) -> str | None:
    if not 1 <= month <= 12 or not 1 <= day <= (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]:
        return None
    name, ordinal = MONTHS[month - 1], DAYS[day].replace("-", " ")
    words = f"the {ordinal} of {name}" if accent == "gb" else f"{name} {ordinal}"
    return words + (f", {year_words(year)}" if year else "")


@rule("ISO date", r"\b(\d{4})[-/](\d{2})[-/](\d{2})\b")
def _(m, text, accent):
    return _date_words(int(m[3]), int(m[2]), int(m[1]), accent)


@rule("numeric date", r"(?<![\d./-])(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})(?![\d/-])")
def _(m, text, accent):
    a, b, y = int(m[1]), int(m[3]), int(m[4])
    y += 2000 if len(m[4]) == 2 and y < 50 else 1900 if len(m[4]) == 2 else 0
    day, month = (a, b) if a > 12 or b <= 12 and accent == "gb" else (b, a)
    return _date_words(day, month, y, accent)


@rule("rate per time", rf"\b({_N})/(mo|yr|hr|wk|day|night|person)\b")
def _(m, text, accent):
    return f"{number_words(int(m[1].replace(',', '')))} per {PER[m[2]]}"


@rule("temperature", r"(-)?\b(\d+(?:\.\d+)?) ?°([CF])\b")
def _(m, text, accent):
    return f"{'minus ' if m[1] else ''}{decimal_words(m[2])} degree{'' if m[2] == '1' else 's'} {dict(C='Celsius', F='Fahrenheit')[m[3]]}"


@rule("degrees", r"\b(\d+(?:\.\d+)?) ?°")
def _(m, text, accent):
    return f"{decimal_words(m[1])} degree{'' if m[1] == '1' else 's'}"


@rule("squared units", r"\b(\d+(?:\.\d+)?) ?(km|m|cm|ft|mi)(?:\^)?([²³23])(?!\w)")
def _(m, text, accent):
    name = {"m": ("meter", "meters")}.get(m[2]) or UNITS[m[2]]
    return f"{decimal_words(m[1])} {'square' if m[3] in '²2' else 'cubic'} {name[m[1] != '1']}"


fixed("powers", r"\b([a-z])²", r"\1 squared")
fixed("cubes", r"\b([a-z])³", r"\1 cubed")


@rule("compound duration", r"\b(\d+)h ?(\d+)m(?:in)?\b")
def _(m, text, accent):
    return f"{number_words(int(m[1]))} hour{'' if m[1] == '1' else 's'} {number_words(int(m[2]))} minute{'' if m[2] == '1' else 's'}"


@rule("ago", r"\b(\d+)([smhdwy]) ago\b")
def _(m, text, accent):
    unit = dict(s="second", m="minute", h="hour", d="day", w="week", y="year")[m[2]]
    return f"{number_words(int(m[1]))} {unit}{'' if m[1] == '1' else 's'} ago"


@rule("about", r"(?<!\S)~ ?(?=[$£€]?\d)")
def _(m, text, accent):
    return "about "


@rule("age", r"\b(\d+)[- ]yr[- ]old\b")
def _(m, text, accent):
    return f"{number_words(int(m[1]))} year old"


@rule("blood pressure", r"\b(BP|blood pressure)(\D{1,12})(\d{2,3})/(\d{2,3})\b")
def _(m, text, accent):
    return f"{m[1]}{m[2]}{number_words(int(m[3]))} over {number_words(int(m[4]))}"


@rule("modifier with unit", rf"\b(\d+)-({_any(UNITS)})\b(?= [a-z])")
def _(m, text, accent):
    return f"{number_words(int(m[1]))} {UNITS[m[2]][0]}"


@rule("unit", rf"(?<![\w.])({_N}|\d*\.\d+) ?({_any(UNITS)})\b(?!/)\.?")
def _(m, text, accent):
    return f"{decimal_words(m[1])} {UNITS[m[2]][m[1] != '1']}{_stop(m, text)}"


@rule("percent range", r"\b(\d+)%?[–-](\d+)%")
def _(m, text, accent):
    return f"{number_words(int(m[1]))} to {number_words(int(m[2]))} percent"


@rule("percent", rf"(?<![\w.])({_N}|\d*\.\d+|\d+\.\d+) ?%")
def _(m, text, accent):
    return f"{decimal_words(m[1])} percent"


@rule("day range", rf"\b({_any(DAY_NAMES)})\.?[–-]({_any(DAY_NAMES)})\b\.?")
def _(m, text, accent):
    return f"{DAY_NAMES[m[1]]} to {DAY_NAMES[m[2]]}"


@rule("day before a date", rf"\b({_any(DAY_NAMES)})\.?,? (?={_any(MONTH_NAMES)}|\d)")
def _(m, text, accent):
    return f"{DAY_NAMES[m[1]]}, "


@rule("sure days", r"\b(Tues|Thurs|Thur|Weds)\b\.?")
def _(m, text, accent):
    return DAY_NAMES[m[1]] + _stop(m, text)


@rule("day-first date", rf"\b(\d{{1,2}})(?:st|nd|rd|th)? ({_any(MONTH_NAMES)})\b\.?(?:,? (\d{{4}}))?")
def _(m, text, accent):
    month = MONTHS.index(MONTH_NAMES[m[2]]) + 1
    return _date_words(int(m[1]), month, m[3] and int(m[3]), "gb")


@rule("month range of days", rf"\b({_any(MONTH_NAMES)})\.? (\d{{1,2}})[–-](\d{{1,2}})\b")
def _(m, text, accent):
    a, b = int(m[2]), int(m[3])
    return f"{MONTH_NAMES[m[1]]} {DAYS[a].replace('-', ' ')} to {DAYS[b].replace('-', ' ')}" if 1 <= a < b <= 31 else None


@rule("month range", rf"\b({_any(MONTH_NAMES)})\.?[–-]({_any(MONTH_NAMES)})\b\.?")
def _(m, text, accent):
    return f"{MONTH_NAMES[m[1]]} to {MONTH_NAMES[m[2]]}"


@rule("month and day", rf"\b({_any(MONTH_NAMES)})\.? (\d{{1,2}})(?:st|nd|rd|th)?\b(?![:%.]\d)(?:, (\d{{4}}))?")
def _(m, text, accent):
    return _date_words(int(m[2]), MONTHS.index(MONTH_NAMES[m[1]]) + 1, m[3] and int(m[3]), "us")


@rule("month and year", rf"\b({_any(MONTH_NAMES)})\.? (\d{{4}})\b")
def _(m, text, accent):
    return f"{MONTH_NAMES[m[1]]} {year_words(int(m[2]))}"


@rule("time range", r"\b(\d{1,2})(?::(\d\d))? ?([ap])\.?m\.?[–-](\d{1,2})(?::(\d\d))? ?([ap])\.?m\b\.?")
def _(m, text, accent):
    return f"{_time(m[1], m[2], m[3])} to {_time(m[4], m[5], m[6])}{_stop(m, text)}"


def _time(hour: str, minute: str | None, meridiem: str | None) -> str:
    h, low = int(hour), int(minute or 0)
    tail = f" {meridiem.upper()} M" if meridiem else ""
    if low:
        return f"{number_words(h)} " + (f"oh {ONES[low]}" if low < 10 else number_words(low)) + tail
    if meridiem:
        return number_words(h) + tail
    return "midnight" if h == 0 else f"{number_words(h)} " + ("o'clock" if h <= 12 else "hundred")


@rule("clock", r"(?<![\d:.])([01]?\d|2[0-3]):([0-5]\d)(?!:?\d)(?: ?([ap])\.?m\b\.?)?")
def _(m, text, accent):
    return _time(m[1], m[2], m[3]) + (_stop(m, text) if m[3] else "")


@rule("hour with meridiem", r"\b(1[0-2]|[1-9]) ?([ap])\.?m\b\.?")
def _(m, text, accent):
    return _time(m[1], None, m[2]) + _stop(m, text)


@rule("century", r"\b(\d{1,2})(?:st|nd|rd|th)[ -]c(?:\.|ent\.)(?=\W|$)")
def _(m, text, accent):
    return f"{ordinal_words(int(m[1]))} century"


@rule("ratio", r"\b(\d{1,3}):(\d{1,3})\b")
def _(m, text, accent):
    return f"{number_words(int(m[1]))} to {number_words(int(m[2]))}"


@rule("rating", r"\b(\d{1,2})/(5|10|100)\b")
def _(m, text, accent):
    return f"{number_words(int(m[1]))} out of {number_words(int(m[2]))}"


@rule("mixed fraction", r"\b(\d+)[ -]?([½⅓⅔¼¾⅛⅜⅝⅞])")
def _(m, text, accent):
    return f"{number_words(int(m[1]))} and {FRACTIONS[m[2]].replace('one ', 'a ', 1)}"


@rule("fraction sign", r"[½⅓⅔¼¾⅛⅜⅝⅞]")
def _(m, text, accent):
    return FRACTIONS[m[0]]


@rule("fraction", r"(?<![\d/])([1-9])/([2-9])(?![\d/])")
def _(m, text, accent):
    top, bottom = int(m[1]), int(m[2])
    name = {2: "half", 4: "quarter"}.get(bottom, ordinal_words(bottom))
    return f"{number_words(top)} {name if top == 1 else 'halves' if bottom == 2 else name + 's'}" if top < bottom else None


@rule("label before a number", rf"\b({_any(LABELS)})\. ?(?=\d)")
def _(m, text, accent):
    return LABELS[m[1]] + " "


@rule("year range", r"\b(1[0-9]\d\d|20\d\d)[–-](1[0-9]\d\d|20\d\d|\d\d)\b")
def _(m, text, accent):
    a, b = int(m[1]), int(m[2]) if len(m[2]) == 4 else int(m[1][:2] + m[2])
    return f"{year_words(a)} to {year_words(b)}" if a < b else None


@rule("number range", rf"(?<![\w.-])({_N})[–-]({_N})(?![\w-]|\.\d)")
def _(m, text, accent):
    a, b = (int(x.replace(",", "")) for x in (m[1], m[2]))
    return f"{number_words(a)} to {number_words(b)}" if a < b and not m[1].startswith("0") else None


@rule("operators", r"(?<=\d) ([+×÷=]) (?=\d)")
def _(m, text, accent):
    return f" {dict(zip('+×÷=', ('plus', 'times', 'divided by', 'equals'), strict=True))[m[1]]} "


fixed("optional plural", r"\b(\w+)\(s\)", r"\1s")


@rule("abbreviation", rf"\b({_any(SHORT)})\.", re.I)
def _(m, text, accent):
    word = SHORT[m[1].lower()]
    return (word.capitalize() if m[1][0].isupper() else word) + _stop(m, text)


fixed("circa", r"\b(?:ca|c)\. ?(?=\d{3,4}\b)", "circa ")
fixed("versus", r"\bvs?\.(?=\s)", "versus")
fixed("regarding", r"\bre:(?=\s)", "regarding")
fixed("also known as", r"\b(?:aka|a\.k\.a\.)", "also known as")
fixed("air conditioning", r"\bA/C\b", "A C")


@rule("ordinal", r"\b(\d{1,4})(?:st|nd|rd|th)\b")
def _(m, text, accent):
    return ordinal_words(int(m[1]))


#: Stretches that no rule touches: pinned readings [word](/phonemes/).
_PINNED = re.compile(r"\[[^\]\n]+\]\(/[^)\n]*/\)")


def normalise(text: str | None, accent: str = "us") -> str | None:
    if not text:
        return text
    parts, at = [], 0
    for m in _PINNED.finditer(text):
        parts += [_apply(text[at : m.start()], accent), m[0]]
        at = m.end()
    return "".join([*parts, _apply(text[at:], accent)])


_DIGIT = re.compile(r"\d")
#: The rules that a text without a digit can need.
_WITHOUT_DIGIT = [r for r in RULES if not r.needs_digit]


def _apply(text: str, accent: str) -> str:
    for r in RULES if _DIGIT.search(text) else _WITHOUT_DIGIT:
        if r.pattern.search(text):
            source = text
            text = r.pattern.sub(lambda m, source=source, r=r: m[0] if (out := r.read(m, source, accent)) is None else out, source)
    return text


def normalised(text: Column, accent: str = "us") -> Column:
    """The text with all rules applied, by one Arrow UDF; null stays null."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([normalise(t, accent) for t in column.to_pylist()], pa.string())

    return run(text)
