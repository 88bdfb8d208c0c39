"""Scalar rules as Spark column expressions: parsing of numbers and dates, tolerance, addresses, text keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABS_TOLERANCE, REL_TOLERANCE = 1.0, 0.005

#: Beginnings of month names and their numbers.
MONTH_STEMS = {"январ": 1, "феврал": 2, "март": 3, "апрел": 4, "мая": 5, "май": 5, "июн": 6, "июл": 7, "август": 8, "сентябр": 9, "октябр": 10, "ноябр": 11, "декабр": 12}
#: Marks of total rows, by profile.
TOTAL_MARKS = {
    "calc": ("итого", "всего", "итог", "оборот за период", "к оплате всего"),
    "register": ("итого", "всего"),
    "digest": ("итого", "всего", "оборот", "сальдо", "баланс", "к оплате", "сумма по", "итог", "total"),
}
#: Queue words and the figures that stand for them.
QUEUE_WORDS = "(перв|втор|трет|четв|зареестр|текущ)"
QUEUE_FIGURES = {"1": "перв", "2": "втор", "3": "трет", "4": "четв", "i": "перв", "ii": "втор", "iii": "трет", "iv": "четв"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_header(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def parse_number(value) -> Column:
    """Double from text as ledgers write it, null where it is none. The last of two different
    separators is decimal; one kind is decimal unless it groups threes at least twice."""
    s = F.trim(F.translate(_c(value).cast("string"), "  −", "  -"))
    parens = s.rlike(r"^\(\s*[^)]+\s*\)$")
    s = F.when(parens, F.regexp_replace(s, r"^\(\s*|\s*\)$", "")).otherwise(s)
    s = F.regexp_replace(s, "%", "")
    s = F.regexp_replace(s, r"(?iu)(руб\.?|коп\.?|₽|р\.)", "")
    s = F.regexp_replace(s, r"[\s'’]+", "")
    minus = s.startswith("-")
    s = F.regexp_replace(s, r"^[+-]+", "")
    ok = s.rlike(r"^[0-9.,]+$")
    dot, comma = F.instr(s, ".") > 0, F.instr(s, ",") > 0
    dot_last = F.length(F.substring_index(s, ".", -1)) < F.length(F.substring_index(s, ",", -1))
    both = F.when(dot_last, F.translate(s, ",", "")).otherwise(F.translate(F.translate(s, ".", ""), ",", "."))
    grouped = s.rlike(r"^[0-9]*([.,][0-9]{3}){2,}$")
    joined = F.translate(s, ".,", "")
    head = F.regexp_extract(s, r"^([0-9]*)", 1)
    single = F.when(grouped, joined).otherwise(F.concat(head, F.lit("."), F.substring(joined, F.length(head) + 1, F.lit(400))))
    plain = F.when(dot & comma, both).when(dot | comma, single).otherwise(s)
    n = plain.try_cast("double")
    return F.when(ok, F.when(minus | parens, -n).otherwise(n))


def _date(y: Column, m: Column, d: Column) -> Column:
    """Null for a day that does not exist; two-digit years turn at 50."""
    y = y.try_cast("int")
    y = F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def parse_date(value) -> Column:
    """Date from ISO-like, day-first and «day month year» text; the first form found decides."""
    t = F.lower(F.trim(F.translate(_c(value).cast("string"), " ", " ")))
    t = F.trim(F.regexp_replace(t, r"г\.?\s*$", ""))
    iso, dmy, word = r"([0-9]{4})[-./]([0-9]{1,2})[-./]([0-9]{1,2})", r"([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{2,4})", r"([0-9]{1,2})\s+([а-яё]{3,})\s+([0-9]{4})"
    g = lambda p, i: F.regexp_extract(t, p, i)
    month = F.lit(None).cast("string")
    for stem, n in reversed(MONTH_STEMS.items()):
        month = F.when(g(word, 2).startswith(stem), F.lit(str(n))).otherwise(month)
    return F.when(t.rlike(iso), _date(g(iso, 1), g(iso, 2), g(iso, 3))).when(t.rlike(dmy), _date(g(dmy, 3), g(dmy, 2), g(dmy, 1))).when(t.rlike(word), _date(g(word, 3), month, g(word, 1)))


def days_in_year(date) -> Column:
    return F.dayofyear(F.make_date(F.year(_c(date)), F.lit(12), F.lit(31)))


def months_back(date, n: int) -> Column:
    """The day is held to the month's last one."""
    return F.add_months(_c(date), -n)


def close(a, b, abs_tol: float = ABS_TOLERANCE, rel_tol: float | None = REL_TOLERANCE) -> Column:
    """|a - b| within max(absolute, relative share of b); rel_tol None: absolute only; null: false."""
    a, b = _c(a), _c(b)
    limit = F.lit(abs_tol) if rel_tol is None else F.greatest(F.lit(abs_tol), F.abs(b) * rel_tol)
    return F.coalesce(F.abs(a - b) <= limit, F.lit(False))


def cents(value) -> Column:
    """Rounded to cents, halves up, by plain IEEE steps, so any engine gives the same bits."""
    return F.floor(_c(value) * 100.0 + 0.5).cast("double") / 100.0


def is_total_row(text, profile: str = "calc") -> Column:
    """text: the joined cells of a row."""
    return F.coalesce(F.lower(_c(text)).rlike("|".join(TOTAL_MARKS[profile])), F.lit(False))


def col_letter(i: int) -> str:
    """Spreadsheet letters of a zero-based column number."""
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def address(sheet, row, column: int) -> Column:
    return F.concat(_c(sheet), F.lit("!" + col_letter(column)), _c(row).cast("string"))


def money(value) -> Column:
    """1 234,50 ₽ with a typographic minus; null as a dash."""
    v = _c(value)
    s = F.translate(F.format_number(F.abs(v), 2), ",.", " ,")
    return F.when(v.isNull(), F.lit("—")).otherwise(F.concat(F.when(v < 0, F.lit("−")).otherwise(F.lit("")), s, F.lit(" ₽")))


def money_signed(value) -> Column:
    return F.concat(F.when(_c(value) > 0, F.lit("+")).otherwise(F.lit("")), money(value))


def plural(n, one: str, few: str, many: str) -> Column:
    n = F.abs(_c(n))
    ten, hundred = n % 10, n % 100
    word = F.when((ten == 1) & (hundred != 11), one).when(ten.between(2, 4) & ~hundred.between(12, 14), few).otherwise(many)
    return F.concat_ws(" ", n.cast("string"), word)


def parse_queue(cell, row_text) -> Column:
    """The queue named in its cell by word, digit or Roman figure; the whole row only where the cell is empty."""
    v = F.lower(F.trim(F.coalesce(_c(cell).cast("string"), F.lit(""))))
    token = F.regexp_replace(F.translate(v, "х", "x"), "[^0-9ivx]", "")
    figure = F.lit(None).cast("string")
    for k, w in QUEUE_FIGURES.items():
        figure = F.when(token == k, w).otherwise(figure)
    none = F.lit("не указана")
    named = lambda x: F.nullif(F.regexp_extract(x, QUEUE_WORDS, 1), F.lit(""))
    return F.when(v != "", F.coalesce(named(v), figure, none)).otherwise(F.coalesce(named(F.lower(F.coalesce(_c(row_text), F.lit("")))), none))


def resolve_party(party, purpose) -> Column:
    """The party's own cell, else a quoted name in the purpose, else a 10- or 12-digit tax id there."""
    p, t = F.trim(F.coalesce(_c(party).cast("string"), F.lit(""))), F.coalesce(_c(purpose).cast("string"), F.lit(""))
    quoted = F.trim(F.regexp_extract(t, "[«\"']([^»\"']{3,60})[»\"']", 1))
    inn = F.regexp_extract(t, r"\b([0-9]{10}|[0-9]{12})\b", 1)
    return F.when(p != "", p).when(quoted != "", quoted).when(inn != "", F.concat(F.lit("ИНН "), inn)).otherwise("")


def tax_ids(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"\b([0-9]{12}|[0-9]{10})\b"), 1)


def number_key(text) -> Column:
    """Digits with a significant fraction, leading zeros kept."""
    s = F.regexp_replace(F.regexp_replace(_c(text).cast("string"), r"[\s  ]", ""), ",", ".")
    s = F.regexp_replace(s, "[^0-9.]", "")
    return F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def text_key(text) -> Column:
    """Letters and digits only, lower case, ё as е."""
    return F.regexp_replace(F.translate(F.lower(_c(text)), "ё", "е"), r"[^\p{L}\p{N}]", "")


def soft_key(text) -> Column:
    """Key of texts that differ in case and white space only."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(_c(text)), r"[ \t\n\x0B\f\r]+", " ")), 256)


def content_hash(data) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_c(data), 256))


def compare_field(found, expected) -> Column:
    """match, mismatch or inconclusive, by numeric key where both have digits, else by text key."""
    a, b = text_key(found), text_key(expected)
    na, nb = number_key(found), number_key(expected)
    digits = (na != "") & (nb != "")
    return F.when(F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe(""), "inconclusive").when(digits, F.when(na == nb, "match").otherwise("mismatch")).when((a == b) | a.contains(b), "match").otherwise("mismatch")


def slug(*texts) -> Column:
    """Names for files: full stops and quotation marks go, all else that is no letter or digit becomes one hyphen; letters stay as
    they are. Several texts are parted by two hyphens."""
    one = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(t), "[.«»\"']", ""), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.concat_ws("--", *[one(t) for t in texts])


def percent_decode(text) -> Column:
    return F.coalesce(F.try_url_decode(F.regexp_replace(_c(text), r"\+", "%2B")), _c(text))


def doc_refs(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"\[(doc-[0-9]+)\]"), 1)


#: Marks of places still to be filled in.
DRAFT = r"\[ПЛЕЙСХОЛДЕР\]|\[TODO\]|\[…\]|\[\.\.\.\]|XXX|указать (дату|номер|сумму|наименование)|____"
#: Inline markup of Markdown. A single asterisk is markup only at the borders of a word.
LINK, CODE, BOLD = r"\[([^\]]+)\]\([^)]*\)", "`([^`]+)`", r"(?s)\*\*(.+?)\*\*|__(.+?)__"
ITALIC = r"(^|[\s(\[«\"'])\*(?!\s)([^*\n]+?)(?<!\s)\*(?=$|[\s.,;:!?)\]»\"'])"


def is_draft(text) -> Column:
    return _c(text).rlike(DRAFT)


def strip_markup(text) -> Column:
    """Text without inline markup."""
    plain = F.regexp_replace(F.regexp_replace(_c(text), LINK, "$1"), CODE, "$1")
    return F.regexp_replace(F.regexp_replace(plain, BOLD, "$1$2"), ITALIC, "$1$2")


def inline_segments(text) -> Column:
    """Pieces of text in order, each with whether it is bold; other inline markup goes. Control signs 1 and 2 mark the borders
    in between, so they are taken out of the text first."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(_c(text), "\x01\x02", ""), LINK, "$1"), CODE, "$1")
    pieces = F.split(F.regexp_replace(plain, BOLD, "\x01$1$2\x02"), "(?=\x01)|(?<=\x02)")
    each = F.transform(pieces, lambda p: F.struct(F.regexp_replace(F.translate(p, "\x01\x02", ""), ITALIC, "$1$2").alias("text"), p.startswith("\x01").alias("bold")))
    return F.filter(each, lambda x: x["text"] != "")


def markdown_escape(text) -> Column:
    return F.replace(F.coalesce(_c(text), F.lit("")), F.lit("|"), F.lit("\\|"))


def text_diagnostics(text) -> dict[str, Column]:
    """Ratios that tell damaged text: replacement signs, controls, Cyrillic share, mean token length."""
    t = F.coalesce(_c(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    # runs of a class are taken out together; a class that is rare in text is looked for first, which builds no string
    count = lambda p: F.length(t) - F.length(F.regexp_replace(t, f"{p}+", ""))
    rare = lambda p: F.when(t.rlike(p), count(p)).otherwise(0)
    words = F.length(F.regexp_replace(F.regexp_replace(t, r"[^ \t\n\r]+", "x"), r"[ \t\n\r]+", ""))
    letters = count(r"[A-Za-zА-Яа-яЁёÀ-ÖØ-öø-ÿ]")
    return {
        "n_chars": F.length(t).cast("long"),
        "n_words": words.cast("long"),
        "bad_ratio": F.round(rare("�") / n, 6),
        "control_ratio": F.round(rare(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") / n, 6),
        "letters": letters.cast("long"),
        "cyrillic_ratio": F.round(rare("[А-Яа-яЁё]") / F.greatest(letters, F.lit(1)), 6),
        "avg_token": F.round((F.length(t) - count(r"[ \t\n\r]")) / F.greatest(words, F.lit(1)), 6),
    }


def is_garbage(d: dict[str, Column], expect_cyrillic: bool = True) -> Column:
    bad = (d["bad_ratio"] > 0.02) | (d["control_ratio"] > 0.05) | ((d["n_chars"] > 200) & (d["avg_token"] < 2))
    return bad | ((d["letters"] >= 30) & (d["cyrillic_ratio"] < 0.15)) if expect_cyrillic else bad


def text_kind(text, min_chars: int = 40) -> Column:
    """short, garbage or text: what a page's status takes from its text alone, so that texts on many pages are looked at once."""
    short = F.length(F.trim(F.coalesce(_c(text), F.lit("")))) < min_chars
    return F.when(short, "short").when(is_garbage(text_diagnostics(text), False), "garbage").otherwise("text")


def page_status(text, has_images, min_chars: int = 40) -> Column:
    return kind_status(text_kind(text, min_chars), has_images)


def kind_status(kind, has_images) -> Column:
    """The status of a page by the kind of its text: short ones are scans where there are images, else blank."""
    kind = _c(kind)
    return F.when((kind == "short") & _c(has_images), "scan").when(kind == "short", "blank").otherwise(kind)
