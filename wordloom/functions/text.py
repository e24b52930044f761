"""Column functions on texts. All are native expressions; blanks include U+3000 where the measure needs it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V


def _c(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


#: Unicode's White_Space, which is what \s matches under (?U).
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


#: What the queries' SQL strips and folds: Latin blanks and the wide one.
SQL_BLANKS = "\t\n\x0b\x0c\r \u3000"
#: Where Unicode breaks lines.
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def stripped(text: Column | str) -> Column:
    """Without blanks of any script at both ends (only the ends are read)."""
    return F.btrim(_c(text), F.lit(BLANKS))


def bared(text: Column | str, blanks: str) -> Column:
    """Without the blanks that are named at both ends (not an option of `stripped`, which `transform` takes as it is and would give positions)."""
    return F.btrim(_c(text), F.lit(blanks))


def tail(text: Column | str) -> Column:
    """Without blanks of any script at the end."""
    return F.rtrim(_c(text), F.lit(BLANKS))


def unspaced(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"(?U)\s+", "")


def ends_in(text: Column, marks: str) -> Column:
    """Whether the last character is one of the marks (of a text that is not empty)."""
    return F.contains(F.lit(marks), F.right(text, F.lit(1)))


def holds(text: Column, words: str) -> Column:
    """Whether the text holds one of the plain words that | separates."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words.split("|")))


def folded(text: Column | str) -> Column:
    """Full-width ASCII as ASCII, and the wide blank as a blank (the part of NFKC that translate can express)."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    return F.translate(_c(text), wide, "".join(chr(0x21 + i) for i in range(94)) + " ")


def tokens(text: Column | str) -> Column:
    """Folded, lower-cased runs: Latin letters and digits whole, CJK runs as overlapping pairs (a single character stays)."""
    runs = F.regexp_extract_all(F.lower(folded(text)), F.lit(f"({V.TOKEN_RUN})"), 1)
    return F.flatten(F.transform(runs, lambda r: F.when((r >= "一") & (F.length(r) > 1), grams(r, 2)).otherwise(F.array(r))))


def normal(text: Column | str) -> Column:
    """The form that content hashes are taken of: folded, blanks in a line folded, at most one empty line."""
    t = F.regexp_replace(folded(text), "\r\n?", "\n")
    lines = F.transform(F.split(t, "\n"), lambda x: F.btrim(F.regexp_replace(x, "[ \t　]+", " ")))
    return stripped(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def content_hash(text: Column | str) -> Column:
    return F.sha2(normal(text), 256)


def chapter_id(order: Column | str) -> Column:
    """CH0001 for 1 (null below 1)."""
    return F.when(_c(order) >= 1, F.format_string("CH%04d", _c(order)))


def numeral(token: Column | str) -> Column:
    """The number that Arabic or Chinese digits write (null if another character occurs)."""
    values = F.create_map(*[x for k, v in V.DIGITS.items() for x in (F.lit(k), F.lit(v))])
    units = F.create_map(*[x for k, v in V.UNITS.items() for x in (F.lit(k), F.lit(v))])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("section"), F.lit(0).alias("digit"))

    def step(a: Column, c: Column) -> Column:
        def state(total, section, digit):
            return F.struct(total.alias("total"), section.alias("section"), digit.alias("digit"))

        one = F.when(a["digit"] == 0, 1).otherwise(a["digit"])
        zero = F.lit(0)
        return (
            F.when(c == "万", state(a["total"] + (a["section"] + a["digit"]) * 10000, zero, zero))
            .when(F.map_contains_key(units, c), state(a["total"], a["section"] + one * units[c], zero))
            .otherwise(state(a["total"], a["section"], values[c]))
        )

    done = F.aggregate(F.split(_c(token), ""), start, step, lambda a: a["total"] + a["section"] + a["digit"])
    return F.when(_c(token).rlike("^[0-9]+$"), F.try_to_number(_c(token), F.lit("9999999999")).cast("int")).when(_c(token).rlike("^[零一二两三四五六七八九十百千万]+$"), done)


def sentences(text: Column | str, base: Column | None = None) -> Column:
    """Sentences that do not break inside paired quotes; array of (at, text), at being the offset of its first character.

    Offsets count from `base`, which starts the fold and so is evaluated once, not once a sentence.
    """
    parts = sentence_parts(text)
    start = F.struct((F.lit(0) if base is None else base).alias("upto"), F.array().cast("array<struct<at:int,text:string>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        lead = F.length(p) - F.length(F.ltrim(p, F.lit(BLANKS)))
        s = stripped(p)
        found = F.when(s == "", a["out"]).otherwise(F.concat(a["out"], F.array(F.struct((a["upto"] + lead).alias("at"), s.alias("text")))))
        return F.struct((a["upto"] + F.length(p)).alias("upto"), found.alias("out"))

    return F.aggregate(parts, start, step, lambda a: a["out"])


def sentence_parts(text: Column | str) -> Column:
    """The text cut after each sentence (blanks stay)."""
    return F.regexp_extract_all(_c(text), F.lit(f"({V.SENTENCE})"), 1)


def sentence_texts(text: Column | str) -> Column:
    return F.filter(F.transform(sentence_parts(text), stripped), lambda s: s != "")


def lines(text: Column | str, breaks: str = LINE_BREAKS, blanks: str = BLANKS) -> Column:
    """Stripped, non-blank lines, broken wherever Unicode breaks lines, unless other breaks are named."""
    return F.filter(F.transform(F.split(_c(text), breaks), lambda x: bared(x, blanks)), lambda x: x != "")


def paragraphs(text: Column | str) -> Column:
    """Lines joined until one ends with a closing mark or the paragraph reaches its length; ruled lines are left out."""
    rows = F.filter(F.transform(F.split(_c(text), "\n"), stripped), lambda x: (x != "") & ~x.rlike(f"(?U){V.NOISE_LINE}"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(a: Column, x: Column) -> Column:
        held = F.concat(a["held"], x)
        ends = ends_in(x, V.PARAGRAPH_MARKS) | (F.length(held) >= V.PARAGRAPH_CHARS)
        done = F.struct(F.concat(a["out"], F.array(held)).alias("out"), F.lit("").alias("held"))
        return F.when(ends, done).otherwise(F.struct(a["out"].alias("out"), held.alias("held")))

    return F.aggregate(rows, start, step, lambda a: F.when(a["held"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["held"]))))


def count(text: Column | str, pattern: str) -> Column:
    """How often the pattern occurs; characters of one class are what is left without all others (no string is made of each)."""
    if one := re.fullmatch(r"\[([^\]\[\\^]+)\]", pattern):
        return F.length(F.regexp_replace(_c(text), f"[^{one[1]}]+", ""))
    return F.regexp_count(_c(text), F.lit(pattern))


def run_lengths(text: Column | str, inside: str, ends: str) -> Column:
    """How many characters of the class `inside` stand between each two of the class `ends`, in order (both without brackets)."""
    return F.transform(F.split(F.regexp_replace(_c(text), f"[^{inside}{ends}]+", ""), f"[{ends}]"), F.length)


def grams(compact: Column | str, n: int) -> Column:
    """All n-grams of a text without blanks, in order (none if it is shorter), in one linear pass of a look-ahead."""
    return F.regexp_extract_all(_c(compact), F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def overlap(of: Column, others: Column) -> Column:
    """Share of the distinct items of `of` that are in `others` (0 if it has none)."""
    own = F.array_distinct(of)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, others)) / F.size(own)).otherwise(F.lit(0.0))


def nearest_rank(values: Column, share: float) -> Column:
    """The value at round-half-even(share * (n - 1)) of the sorted values."""
    return F.element_at(F.array_sort(values), (F.bround(share * (F.size(values) - 1)) + 1).cast("int"))


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(F.lit(0.0))


def deviation(values: Column) -> Column:
    """Population standard deviation, from sums of values and squares (a mean inside the lambda would be taken anew for each item)."""
    sums = F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    n = F.size(values)
    return F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), sums["q"] / n - F.pow(sums["s"] / n, 2)))).otherwise(F.lit(0.0))


def share(values: Column, test) -> Column:
    return F.when(F.size(values) > 0, F.size(F.filter(values, test)) / F.size(values)).otherwise(F.lit(0.0))


def tone(sentence: Column | str) -> Column:
    s = _c(sentence)
    return F.when(holds(s, "|".join(V.HORROR)), "恐怖").when(holds(s, "？|?"), "紧张").when(holds(s, "！|!"), "热血").otherwise("其他")


def themes(sentence: Column | str) -> Column:
    found = F.filter(F.array(*[F.when(holds(_c(sentence), "|".join(w)), k) for k, w in V.THEME_WORDS.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("其他")))


def without_wrappers(text: Column | str) -> Column:
    """Without repeated labels such as （开篇钩） and 上一章： at the start (twenty rounds at most)."""
    return F.regexp_replace(_c(text), "^(?:[：: 　\n]*+(?:（(?:前情承接|开篇钩|核心事件|伏笔照应|章尾钩)）|上一章[:：])?+){1,20}+", "")


def slug(title: Column | str, other: str = "book") -> Column:
    s = F.btrim(F.regexp_replace(_c(title), "[^0-9A-Za-z一-鿿._-]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit(other)).otherwise(s)


def flat(text: Column | str, most: int = 300, blanks: str = BLANKS) -> Column:
    """On one line, runs of blanks folded, cut to `most` characters."""
    one = bared(F.regexp_replace(_c(text), f"[{blanks}]+", " "), " ")
    return F.when(F.length(one) > most, F.concat(F.left(one, F.lit(most)), F.lit("…"))).otherwise(one)


def flat_snippet(text: Column | str, most: int = 300) -> Column:
    """The text on one line, or that it has no body (hash marks alone are none)."""
    return F.when(F.ltrim(stripped(text), F.lit("#")) == "", "（该片段无正文）").otherwise(flat(text, most))


def budget(per_thousand: Column | str, words: Column | str, floor: int) -> Column:
    """A density as an absolute number for so many characters, at least `floor`."""
    return F.greatest(F.lit(floor), F.bround(_c(per_thousand) * _c(words) / 1000).cast("int"))


def temperatures(n: Column | str) -> Column:
    low, high = V.TEMPERATURES
    return F.transform(F.sequence(F.lit(0), _c(n) - 1), lambda i: F.bround(F.lit(low) + (high - low) * i / (_c(n) - 1), 2))


def located(text: Column | str, quote: Column | str) -> Column:
    """Offset of the quote in the text if it occurs exactly once, else null."""
    t, q = _c(text), stripped(quote)
    first = F.position(q, t)
    second = F.position(q, t, first + F.length(q))
    return F.when((q != "") & (first > 0) & (second == 0), first - 1)


def quotes(text: Column | str) -> Column:
    """What stands in quotes anywhere in the text, stripped, each once, in order of first occurrence (a quote may lack its end)."""
    found = F.transform(F.regexp_extract_all(_c(text), F.lit(V.QUOTE), 1), stripped)
    return F.array_distinct(F.filter(found, lambda x: x != ""))
