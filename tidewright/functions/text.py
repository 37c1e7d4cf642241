"""Column functions on text: white space, truncation, words, tags and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the scripting language of the data's producers knows it, and words.
WHITE = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[A-Za-z0-9][A-Za-z0-9'-]*"
_WHITE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
REASONING_TAGS = ("analysis", "think", "thinking", "thoughts")
ANSWER_TAGS = ("recommendation", "answer")
OLD_REASONING_TAGS, OLD_ANSWER_TAGS = ("analysis", "thinking", "thoughts"), ("recommendation",)
HIDDEN_TAGS = ("hidden_reasoning", "reasoning", "analysis", "think", "thinking", "thoughts")
DEFAULT_ANSWER = "Use the grounded reasoning above as a concise user preference profile."
REASONING_HEADER = "Recommendation reasoning:"
_R, _A = "|".join(REASONING_TAGS), "|".join(ANSWER_TAGS)
BLOCKS = rf"(?is)<(?:{_R})>(.*?)</(?:{_R})>\s*<(?:{_A})>(.*?)</(?:{_A})>"
INNER = rf"(?i)</?(?:{_R}|{_A})>"

#: Tags and marks that are taken out of answers, and labels before them.
MARKS = r"(?is)</?(?:think|answer|thinking|thoughts|hidden_reasoning|reasoning|analysis)>|</?tool_call>|```.*?```"
LABEL = r"(?i)^(?:recommendation|answer|final answer|final)\s*[:：]\s*"
_HIDDEN = "|".join(HIDDEN_TAGS)
BLOCK = rf"<\s*(?:{_HIDDEN})\s*>.*?<\s*/\s*(?:{_HIDDEN})\s*>"


def let(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f uses it."""
    return F.transform(F.array(x), f)[0]


def blank(x: Column) -> Column:
    return x.isNull() | (x == "")


def first_truthy(*xs: Column) -> Column:
    """The first value that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])


def strip(x: Column) -> Column:
    """Without white space at both ends; only the ends are looked at, however long the text is."""
    return F.btrim(F.coalesce(x, F.lit("")), F.lit(" " + _WHITE_CHARS))


def compact(x: Column, limit: int = 0) -> Column:
    """White space collapsed and trimmed; over the limit, cut with a marker (limit 0: whole)."""
    blanks = F.translate(F.coalesce(x, F.lit("")), _WHITE_CHARS, " " * len(_WHITE_CHARS))
    own = F.trim(F.regexp_replace(blanks, "  +", " "))
    return truncated(own, limit, 15, " [TRUNCATED]")


def truncated(x: Column, limit: int, reserve: int, marker: str) -> Column:
    if limit <= 0:
        return x
    cut = F.rtrim(F.substring(x, 1, limit - reserve), F.lit(" " + _WHITE_CHARS))
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(cut, F.lit(marker)))


def normalize(x: Column) -> Column:
    return compact(F.lower(x))


def word_list(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(x: Column) -> Column:
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(WORD)).cast("long")


def runs(x: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), rf"{WHITE}+"), lambda w: w != "")


def first_words(x: Column, n: int) -> Column:
    """The first n runs, joined by blanks, if there are more; else the text itself."""
    own = runs(x)
    return F.when(F.size(own) <= n, x).otherwise(F.array_join(F.slice(own, 1, n), " "))


def last_words(x: Column, n: int) -> Column:
    """The last n runs, joined by blanks, if there are more; else the text itself: a prompt cut from the left."""
    own = runs(x)
    return F.when(F.size(own) <= n, x).otherwise(F.array_join(F.slice(own, F.greatest(F.size(own) - n, F.lit(0)) + 1, F.lit(n)), " ")) if n > 0 else x


def blocks(x: Column) -> Column:
    """Struct of reasoning, answer and whether both tags stand in the text."""
    own = F.coalesce(x, F.lit(""))
    has = own.rlike(BLOCKS)
    return F.struct(
        F.when(has, strip(F.regexp_extract(own, BLOCKS, 1))).otherwise("").alias("think"), F.when(has, strip(F.regexp_extract(own, BLOCKS, 2))).otherwise(strip(own)).alias("answer"), has.alias("has_tags")
    )


def canonical_tags(x: Column) -> Column:
    """Synonym tags made canonical, tool-call tags dropped."""
    own = F.coalesce(x, F.lit(""))
    for names, tag in ((OLD_REASONING_TAGS, "think"), (OLD_ANSWER_TAGS, "answer")):
        own = F.regexp_replace(own, rf"(?i)<\s*(?:{'|'.join(names)})\s*>", f"<{tag}>")
        own = F.regexp_replace(own, rf"(?i)<\s*/\s*(?:{'|'.join(names)})\s*>", f"</{tag}>")
    return strip(F.regexp_replace(own, "(?i)</?tool_call>", ""))


def without_marks(x: Column) -> Column:
    """Tags and fenced code taken out."""
    return strip(F.regexp_replace(F.coalesce(x, F.lit("")), MARKS, ""))


def inside_answer(x: Column) -> Column:
    """Text after the last answer tag, up to the first end tag after it."""
    return F.regexp_replace(F.regexp_extract(x, r"(?is)^.*<answer>(.*)$", 1), r"(?is)</answer>.*$", "")


def answer_of(x: Column) -> Column:
    """Text in the last answer tag; without one, the text without reasoning blocks and label."""

    def of(own: Column) -> Column:
        outside = strip(F.regexp_replace(without_marks(F.regexp_replace(own, f"(?is){BLOCK}", "")), LABEL, ""))
        return F.when(own.rlike("(?i)<answer>"), without_marks(inside_answer(own))).otherwise(outside)

    return let(canonical_tags(x), of)


def tagged_assistant(x: Column, fallback: str | Column = "") -> Column:
    """Exactly one reasoning and one answer block; without both, the whole text and the fallback (the row's own, or a fixed one)."""
    b = blocks(strip(x))
    clean = lambda c: strip(F.regexp_replace(c, INNER, ""))
    form = lambda t, a: F.concat(F.lit("<think>\n"), t, F.lit("\n</think>\n<answer>\n"), a, F.lit("\n</answer>"))
    own = strip(F.coalesce(fallback if isinstance(fallback, Column) else F.lit(fallback), F.lit("")))
    default = F.when(own == "", DEFAULT_ANSWER).otherwise(own)
    good = b["has_tags"] & (clean(b["think"]) != "") & (clean(b["answer"]) != "")
    return F.when(good, form(clean(b["think"]), clean(b["answer"]))).otherwise(form(clean(strip(x)), default))


def _tie(x: Column, seven: Column) -> Column:
    """Where a number lies (below 0, 0, above 0) against its seven digits, exactly: the rest of a product of two doubles counts."""
    digits, k = F.replace(F.split_part(seven, F.lit("e"), F.lit(1)), F.lit("."), F.lit("")).cast("double"), F.split_part(seven, F.lit("e"), F.lit(2)).cast("int") - 6
    a, w = F.when(k < 0, x).otherwise(digits), F.pow(F.lit(10.0), F.abs(k))
    high = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    p, ah, wh = a * w, high(a), high(w)
    rest = ((ah * wh - p) + ah * (w - wh) + (a - ah) * wh) + (a - ah) * (w - wh)
    return F.when(F.abs(k) > 22, 1).when(k < 0, F.signum((p - digits) + rest)).otherwise(F.signum((x - p) - rest))


def number(x: Column) -> Column:
    """A number with six digits in its shortest form: 5, 4.5, 0.333333, 1e+06.

    Rounded as C does, by the exact value and half to even; only seven digits that end in 5 can be a tie.
    (Below 1e-16 and from 1e29 on, where powers of ten aren't exact doubles, such a tie is rounded up.)
    """
    x = x.cast("double")
    named = F.array(F.struct(x.alias("x"), F.abs(x).alias("size"), F.format_string("%.6e", F.abs(x)).alias("seven")))
    return F.transform(F.transform(named, lambda r: _six_digits(r["x"], r["size"], r["seven"])), _shortest)[0]


def _six_digits(x: Column, size: Column, seven: Column) -> Column:
    even = F.substring(F.regexp_extract(seven, r"(\d)5e", 1), 1, 1).isin("0", "2", "4", "6", "8")
    side = _tie(size, seven)
    down = seven.contains("5e") & (seven.try_cast("double") == size) & ((side < 0) | ((side == 0) & even))
    return F.when(down, F.concat(F.when(x < 0, "-").otherwise(""), F.replace(seven, F.lit("5e"), F.lit("e")))).when(x.isNotNull(), F.format_string("%.5e", x))


def _shortest(science: Column) -> Column:
    v = science.cast("double")
    plain = F.regexp_replace(v.cast("decimal(20,10)").cast("string"), r"0+$", "")
    return F.when(science.isNull(), None).when(v == 0, "0").when((F.abs(v) >= 1e6) | (F.abs(v) < 1e-4), F.regexp_replace(science, r"\.?0+e", "e")).when(v == F.floor(v), v.cast("long").cast("string")).otherwise(plain)


def block_cut(x: Column, limit: int) -> Column:
    """Trimmed; over the limit, cut with a marker on a line of its own (limit 0: whole). White space stays."""
    return truncated(strip(x), limit, 16, "\n[TRUNCATED]")


def file_safe(x: Column, root: str = "") -> Column:
    """A path as a name for files: its root goes, slashes become two underscores, blanks and colons one."""
    own = F.when(x.startswith(f"{root}/"), F.substr(x, F.lit(len(root) + 2))).otherwise(x) if root else x
    return F.translate(F.replace(own, F.lit("/"), F.lit("__")), " :", "__")


def shortened(x: Column, limit: int) -> Column:
    """For messages: over the limit, cut with a marker on a line of its own."""
    own = F.coalesce(x, F.lit(""))
    return F.when(F.length(own) <= limit, own).otherwise(F.concat(F.left(own, F.lit(limit)), F.lit("\n...[truncated]")))


def with_reasoning(history: Column, reasoning: Column) -> Column:
    r = strip(reasoning)
    return F.when(r == "", strip(history)).otherwise(F.concat(strip(history), F.lit(f"\n\n{REASONING_HEADER}\n"), r))
