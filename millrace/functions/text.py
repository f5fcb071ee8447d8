"""Text functions as Spark columns. Only Unicode normalisation and exact case folding need Python."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All characters that Unicode white space tests accept, for regular expressions of any engine.
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same as a class of Java, which tells most letters by two tests and not by one for each range.
WS_JAVA = r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
#: The same characters, for functions that take a set of them.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Decimal digits of any script.
DIGIT = r"\p{Nd}"
#: Line boundaries of ``str.splitlines``.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


@dataclass(frozen=True)
class Rule:
    """A replacement on a line; ``{ws}`` in the pattern stands for white space, ``{digit}`` for any decimal digit."""

    name: str
    pattern: str
    replacement: str = ""

    @property
    def regex(self) -> str:
        """For Java and RE2."""
        return "(?i)" + self.pattern.replace("{ws}", WS).replace("{ws_inner}", WS[1:-1]).replace("{digit}", DIGIT)

    @property
    def python_regex(self) -> str:
        """For Python, where letters of either case are those of ASCII alone, as in Java, but words those of any script."""
        body = self.regex.removeprefix("(?i)").replace(DIGIT, r"(?u:\d)").replace(r"\b", r"(?u:\b)")
        return f"(?ai:{body})"


@dataclass(frozen=True)
class Publisher:
    """Names that a publisher's page chrome carries."""

    domain: str = "schemesinindia.in"
    name: str = "Schemes In India"
    slogan: str = "All Indian Government Schemes"
    editor: str = "Sanket Ghogare"
    initials: str = "SG"


def boilerplate_rules(publisher: Publisher = Publisher()) -> tuple[Rule, ...]:
    """The page chrome to remove, in the order in which it is removed."""
    domain, editor = re.escape(publisher.domain), publisher.editor
    name, slogan, by = publisher.name, publisher.slogan, publisher.initials
    facts = r"How we verify scheme facts{ws}*\([^)]*\)"
    byline = rf"\b(?:by{{ws}}*)?{editor}{{ws}}*\([^)]*\){{ws}}*·?{{ws}}*Editor,?{{ws}}*{name}"
    return (
        Rule("channel_in_brackets", r"{ws}*✕?{ws}*\({ws}*https?://{ws}*(?:whatsapp\.com|\.com/channel|t\.me)[^)]*\)", " "),
        Rule("channel_link", r"{ws}*https?://(?:whatsapp\.com|t\.me)/[^{ws_inner}]*", " "),
        Rule("share_link", r"{ws}*\({ws}*https?://{ws}*(?:api\.)?\.com/send\?[^)]*\)", " "),
        Rule("publisher_in_brackets", rf"{{ws}}*\([^)]*{domain}[^)]*\)", " "),
        Rule("publisher_encoded", rf"{{ws}}*https%3A%2F%2F{domain}[^)]*\)?", " "),
        Rule("share_pair", r"{ws}*[✕x]?{ws}*WhatsApp{ws}*\([^)]*\){ws}*Telegram{ws}*\([^)]*\)", " "),
        Rule("share_word", r"{ws}*\b(?:WhatsApp|Telegram)\b", " "),
        Rule("share_on", r"\bShare{ws}+on{ws}*WhatsApp\b"),
        Rule("help_others", r"\bHelp others find this scheme\b"),
        Rule("tap_to_mark", r"\bTap a document to mark it as ready{ws}*[·.]?{ws}*Progress saved automatically\b"),
        Rule("slogan", rf"\b{domain}{{ws}}*[—-]{{ws}}*{slogan}{{ws}}*"),
        Rule("documents_ready", r"\b{digit}+/{digit}+{ws}+documents ready\b"),
        Rule("checked_by", rf"\b{by}{{ws}}+Written{{ws}}+(?:and|&){{ws}}+fact-checked{{ws}}+by.*?{facts}"),
        Rule("byline_and_facts", rf"{byline}{{ws}}*{facts}"),
        Rule("byline", byline),
        Rule("facts", rf"\b{facts}"),
        Rule("editor", rf"\b{editor},?{{ws}}*Editor{{ws}}*\([^)]*\)"),
        Rule("last_verified", r"\bLast verified:{ws}*[^·|\n]+[·|]?"),
        Rule("fact_checked", rf"\b{by}{{ws}}+Written{{ws}}+(?:and|&){{ws}}+fact-?checked\b"),
        Rule("last_verified_on", r"\bLast{ws}+Verified{ws}*:?{ws}*{digit}{1,2}{ws}+[A-Za-z]+{ws}+{digit}{4}"),
        Rule("cross", r"{ws}*✕{ws}*", " "),
    )


RULES = boilerplate_rules()
#: A line without any of these has nothing that a rule removes.
MARKERS = (
    r"(?i)✕|whatsapp|telegram|t\.me|\.com/|find this scheme|mark it as ready|documents ready|verify scheme facts|"
    r"fact-?checked|editor|verified|" + re.escape(Publisher().domain)
)
#: A text without any of these, in small letters, has no line with MARKERS.
HINTS = (
    "✕", "whatsapp", "telegram", "t.me", ".com/", "find this scheme", "mark it as ready", "documents ready", "verify scheme facts",
    "checked", "editor", "verified", Publisher().domain,
)


def _has_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        found = found | F.contains(text, F.lit(part))
    return found


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def nfkc(text: Column) -> Column:
    """NFKC; texts of ASCII alone do not reach Python."""

    @F.pandas_udf("string")
    def normalize(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    # a function in Python gets every row, whatever case it stands in: so null in place of what it has nothing to do with
    return F.when(is_ascii(text), text).otherwise(normalize(F.when(~is_ascii(text), text)))


def trim_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.filter(F.split(text, f"{WS_JAVA}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def apply_rules(line: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    for rule in rules:
        # only a line feed ends a line
        line = F.regexp_replace(line, "(?d)" + rule.regex, rule.replacement)
    return line


def clean_lines(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The different lines of a cleaned text, in order of their first occurrence; ``text`` is normalised."""
    def only(x: Column, marks: tuple[str, ...], change: Column) -> Column:
        return F.when(_has_any(x, marks), change).otherwise(x)

    # each step is of an array of one, so that it is evaluated once for all its uses
    one = F.array(text)
    one = F.transform(one, lambda x: only(x, ("\u00a0", "\u0000"), F.translate(x, "\u00a0\u0000", " ")))
    one = F.transform(one, lambda x: only(x, ("\r",), F.regexp_replace(x, r"\r\n?", "\n")))
    one = F.transform(one, lambda x: only(x, ("\t", "  "), F.regexp_replace(x, "\t[ \t]*| [ \t]+", " ")))
    ends = F.lit(" |-")

    def lines(x: Column) -> Column:
        # one step for each pass over the lines, so that no expression is evaluated twice
        return F.transform(F.split(x, "\n"), trim_ws)

    def bare(found: Column) -> Column:
        return F.transform(found, lambda x: F.btrim(x, ends))

    def ruled(x: Column) -> Column:
        found = F.transform(lines(x), lambda x: F.when(x.rlike(MARKERS), apply_rules(x, rules)).otherwise(x))
        return bare(F.transform(found, lambda x: F.regexp_replace(x, "[ \t]+", " ")))

    if rules:
        hinted = lambda x: F.exists(F.array(F.lower(x)), lambda low: _has_any(low, HINTS))
        cleaned = F.transform(one, lambda x: F.when(hinted(x), ruled(x)).otherwise(bare(lines(x))))
    else:
        cleaned = F.transform(one, lambda x: bare(lines(x)))
    cleaned = F.element_at(cleaned, 1)
    return F.array_distinct(F.filter(cleaned, lambda x: x != ""))


def clean_text(text: Column, rules: tuple[Rule, ...] = RULES, normalize: bool = True) -> Column:
    """White space squeezed, page chrome removed, empty and repeated lines dropped. Null stays null."""
    return F.array_join(clean_lines(nfkc(text) if normalize else text, rules), "\n")


def clean_text_py(text: str, rules: tuple[Rule, ...] = RULES) -> str:
    """``clean_text`` for kernels that are in Python anyway."""
    text = unicodedata.normalize("NFKC", text).replace("\xa0", " ").replace("\x00", "")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\t" in text or "  " in text:
        text = re.sub("\t[ \t]*| [ \t]+", " ", text)
    lines = map(str.strip, text.split("\n"))
    low = text.lower()
    if rules and any(hint in low for hint in HINTS):
        lines = [_ruled(line, rules) if re.search(MARKERS, line) else line for line in lines]
    seen = dict.fromkeys(line.strip(" |-") for line in lines)
    seen.pop("", None)
    return "\n".join(seen)


def _ruled(line: str, rules: tuple[Rule, ...]) -> str:
    for rule in rules:
        line = re.sub(rule.python_regex, rule.replacement, line)
    return re.sub("[ \t]+", " ", line)


def split_lines(text: Column) -> Column:
    """Lines at any line boundary, trimmed, without the empty ones."""
    return F.filter(F.transform(F.split(text, LINE_ENDS), trim_ws), lambda x: x != "")


def sentences(line: Column) -> Column:
    """Sentences of a line: up to end marks that white space or the end follows."""
    found = F.regexp_extract_all(line, F.lit(rf"(?s).+?(?:[.!?]+(?={WS}|$(?!\n))|$(?!\n))"), F.lit(0))
    return F.filter(F.transform(found, trim_ws), lambda x: x != "")


#: ``is_list_item``, ``split_lines`` and ``sentences`` for kernels that are in Python anyway.
LIST_ITEM = re.compile(r"(?:[-*•]|\d+[.)])\s+")
_MARKS = re.compile(r"[.!?]+(?=\s|\Z)")


def split_lines_py(text: str) -> list[str]:
    return [x for x in map(str.strip, text.splitlines()) if x]


def sentences_py(line: str) -> list[str]:
    found, begin = [], 0
    for marks in _MARKS.finditer(line):
        if marks.end() - begin > 1:  # a sentence has something before its end marks
            found.append(line[begin : marks.end()].strip())
            begin = marks.end()
    found.append(line[begin:].strip())
    return [x for x in found if x]


def is_list_item(line: Column) -> Column:
    return line.rlike(rf"^(?:[-*•]|{DIGIT}+[.)]){WS}+")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def file_id(url: Column) -> Column:
    return F.substring(F.md5(url.cast("binary")), 1, 12)


def chunk_id(source_url: Column, index: Column) -> Column:
    return F.concat(F.substring(F.sha2(source_url.cast("binary"), 256), 1, 12), F.lit("-"), F.format_string("%04d", index))


def has_share_text(heading: Column) -> Column:
    return heading.rlike("(?i)whatsapp|https?://")


def is_faq(heading: Column) -> Column:
    """A question heading, whose short answer is kept."""
    return heading.rlike(rf"\?{WS}*$") & ~has_share_text(heading)


#: The beginnings of structural headings.
HEADING_STARTS = (
    "How to", "Benefits of", "Who is", "Documents Required", "Official", "Frequently Asked", "Agriculture Infrastructure",
)


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_heading(line: Column) -> Column:
    """A short line that asks, begins like a heading, or is in capitals."""
    n = word_count(line)
    starts = "|".join(HEADING_STARTS)
    shaped = line.rlike(rf"^(?:.+\?{WS}*|(?:{starts}).+)$")
    return n.between(1, 12) & (F.length(line) <= 120) & (shaped | is_upper(line))


def is_heading_py(line: str) -> bool:
    """``is_heading`` of a line of ``split_lines_py``, for kernels that are in Python anyway."""
    if not line or len(line) > 120 or len(line.split()) > 12:
        return False
    shaped = (line[-1] == "?" and len(line) > 1) or (line.startswith(HEADING_STARTS) and line not in HEADING_STARTS)
    return shaped or (line.upper() == line and line.lower() != line)


@lru_cache(maxsize=1)
def folded_otherwise() -> str:
    """A class of characters in which are all letters that lower-casing alone does not fold, or folds by context.

    It is what lies outside long ranges without such letters, so that it has few ranges and is quickly tested. Sharp s
    is not among these letters, since ``fold`` replaces it.
    """
    letters = (chr(k) for k in range(0x10000) if not 0xD800 <= k < 0xE000)
    odd = [ord(c) for c in letters if c in "ΣİΣ" or (c != "ß" and c.casefold() != c.lower())]
    gaps = [(a + 1, b - 1) for a, b in zip([-1, *odd], [*odd, 0xD800]) if b - a > (2 if a < 0x180 else 200)]
    return "[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in gaps if b < 0xD800 and a <= b) + "]"


def fold(text: Column) -> Column:
    """Case folded over all of Unicode; only texts with letters that lower-casing may not fold reach Python."""

    @F.pandas_udf("string")
    def casefold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else v.casefold())

    plain = F.replace(text, F.lit("ß"), F.lit("ss"))
    odd = plain.rlike(folded_otherwise())
    return F.when(odd, casefold(F.when(odd, text))).otherwise(F.lower(plain))


def contains_all(folded_text: Column, folded_terms: Column) -> Column:
    """Whether every term occurs, both folded; true for no terms."""
    return F.forall(F.coalesce(folded_terms, F.array().cast("array<string>")), lambda t: F.contains(folded_text, t))


def fold_terms(df: DataFrame, key: str, terms: str) -> DataFrame:
    """``df``, one row for each ``key``, with its terms folded, which functions over arrays cannot call Python for."""
    each = df.select(F.col(key).alias("__key"), F.explode(terms).alias("__t")).select("__key", fold(F.col("__t")).alias("__t"))
    folded = each.groupBy("__key").agg(F.collect_list("__t").alias("__terms"))
    joined = df.join(folded, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    return joined.withColumn(terms, F.coalesce("__terms", F.array().cast("array<string>"))).drop("__terms")
