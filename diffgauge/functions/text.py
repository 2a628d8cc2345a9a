"""Column expressions over code text. All of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Markers, placeholders and the sub-word word-start sign.
NUMBER_PLACEHOLDER = "<NUMBER>"
NUMBER_WORD = "NUM"
START_MARK = "<s>"
END_MARK = "</s>"
WORD_START = "Ġ"
LOG_SEPARATOR = "#################################"

# The blanks at which words of any script are split, as a character class
BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
ANY_SPACE = BLANK + "+"
PURE_PUNCT = r"^\p{Punct}*$"
WORD_PATTERN = r"[\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def change_number(ref) -> Column:
    """CHANGE in refs/changes/NN/CHANGE/PATCH."""
    return F.split(_col(ref), "/")[3].cast("int")


def patch_number(ref) -> Column:
    return F.split(_col(ref), "/")[4].cast("int")


def range_bucket(number, step: int) -> Column:
    """Inclusive 1-based range [lo, hi] of width ``step`` holding the number."""
    lo = (F.floor((_col(number) - 1) / step) * step + 1).cast("long")
    return F.struct(lo.alias("lo"), (lo + step - 1).alias("hi"))


def strip_plus(c) -> Column:
    return F.regexp_replace(_col(c), r"^\++", "")


def percent_encode(c) -> Column:
    """RFC 3986 encoding without safe characters, from form encoding."""
    out = F.url_encode(_col(c))
    for form, rfc in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(rfc))
    return out


def number_word(c) -> Column:
    return F.replace(_col(c), F.lit(NUMBER_PLACEHOLDER), F.lit(NUMBER_WORD))


def with_markers(c, spaced_end: bool = True, null_as_nan: bool = False) -> Column:
    """Sequence markers; training puts a space before the end mark, scoring does not."""
    body = number_word(c)
    if null_as_nan:
        body = F.coalesce(body, F.lit("nan"))
    return F.concat(F.lit(START_MARK + " "), body,
                    F.lit((" " if spaced_end else "") + END_MARK))


def drop_placeholder(c) -> Column:
    return F.replace(_col(c), F.lit(NUMBER_PLACEHOLDER), F.lit(""))


def mask_digits(c) -> Column:
    """Runs of decimal digits of any script as one word."""
    return F.regexp_replace(_col(c), r"\p{Nd}+", NUMBER_WORD)


def tokens_per_line(c, minus_one: bool = True) -> Column:
    """Single-space split, empty pieces counted; the end mark is glued to the
    last word, which makes the published count words minus one."""
    return F.size(F.split(_col(c), " ")) - F.lit(1 if minus_one else 0)


def strip_space(c) -> Column:
    return F.regexp_replace(_col(c), f"^{ANY_SPACE}|{ANY_SPACE}$", "")


def words_per_line(c) -> Column:
    body = strip_space(c)
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, ANY_SPACE)))


def line_words(c) -> Column:
    """All words of a line, whitespace split; a blank line has none."""
    body = strip_space(c)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, ANY_SPACE))


def line_tokens(c) -> Column:
    """Distinct lower-case words of a line."""
    return F.array_distinct(line_words(F.lower(_col(c))))


def unescape_newlines(c) -> Column:
    return F.replace(_col(c), F.lit("\\n"), F.lit("\n"))


def label_flag(c) -> Column:
    return _col(c) != 0


def is_pure_punctuation(c) -> Column:
    return _col(c).rlike(PURE_PUNCT)


def has_punctuation(c) -> Column:
    return _col(c).rlike(r"\p{Punct}")


def strip_quotes(c) -> Column:
    return F.translate(_col(c), "\"'", "")


def plain_words(c) -> Column:
    """Runs of letters and digits; underscores and punctuation split."""
    return F.regexp_extract_all(_col(c), F.lit(f"({WORD_PATTERN})"), 1)


def fixed_window(ids, length: int = 128, pad: int = 1) -> Column:
    """Cut to ``length`` and pad on the right, with the attention mask."""
    head = F.slice(_col(ids), 1, length)
    gap = F.greatest(F.lit(length) - F.size(head), F.lit(0))
    return F.struct(
        F.concat(head, F.array_repeat(F.lit(pad), gap)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(head)),
                 F.array_repeat(F.lit(0), gap)).alias("attention_mask"))


def quoted(token) -> Column:
    """A token as a quoted list item: double quotes when it holds a single one."""
    t = F.replace(_col(token), F.lit("\\"), F.lit("\\\\"))
    single, double = F.contains(t, F.lit("'")), F.contains(t, F.lit('"'))
    return (F.when(single & ~double, F.concat(F.lit('"'), t, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'"))))


def unquoted_items(body) -> Column:
    """The items of a quoted list body, quotes and escapes removed."""
    raw = F.regexp_extract_all(
        _col(body), F.lit(r"""('(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+")"""), 1)
    return F.transform(raw, lambda t: F.regexp_replace(
        F.substring(t, F.lit(2), F.length(t) - 2), r"\\(.)", "$1"))


def log_record(before, after, changed, suggestion) -> Column:
    """One text log: before, separator, after, then the two token lists."""
    def shown(tokens):
        return F.concat(F.lit("["), F.array_join(F.transform(_col(tokens), quoted), ", "), F.lit("]"))
    return F.concat_ws("\n", _col(before), F.lit(LOG_SEPARATOR), _col(after),
                       F.concat(F.lit("changed_token:"), shown(changed)),
                       F.concat(F.lit("suggestion:"), shown(suggestion)))


def capitalise(c) -> Column:
    """First letter upper case, all others lower case."""
    return F.concat(F.upper(F.substring(_col(c), 1, 1)), F.lower(F.substr(_col(c), F.lit(2))))


def block_contains(block, needle) -> Column:
    """The needle inside the lines of a block joined without separator."""
    return F.contains(F.array_join(_col(block), ""), _col(needle))


def first_line_with(block, needle) -> Column:
    """1-based index of the first line holding the needle, 0 when none does."""
    return F.coalesce(F.array_position(
        F.transform(_col(block), lambda line: F.contains(line, _col(needle))), F.lit(True)),
        F.lit(0)).cast("int")
