"""Pull code out of generated text (F22-F27) as JVM regex expressions.

The reference tries a cascade of Python regexes; each step here is a
``regexp_like`` guard plus ``regexp_extract`` (Spark returns '' both for
"no match" and "empty match", so the guard decides), chained with CASE.
The language-specific fence pattern is built per row in SQL; Spark keeps
the last compiled pattern per task, so rows of one language reuse it.

White space is spelled out as the characters of Python's ``\\s`` (Java's is
ASCII); Spark's ``trim`` only removes spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import SPACE, WORD, spelled

# Fixed values (must equal the reference's): reasoning markers, in order.
THINKING_MARKERS = (
    r"Now write the code:?\s*\n",
    r"Implementation:?\s*\n",
    r"Code:?\s*\n",
    r"Solution:?\s*\n",
    r"Here's the code:?\s*\n",
)
FENCE = "```"

_WS_STRIP = rf"^{SPACE}+|{SPACE}+\z"


def py_strip(s: Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace at both ends)."""
    return F.regexp_replace(s, _WS_STRIP, "")


def _escaped_language(language: Column) -> Column:
    """``re.escape`` for the fence tag: ASCII space and punctuation (except
    ``_``) backslashed; letters, digits and non-ASCII characters stay as
    they are (Java rejects a backslash before a letter)."""
    return F.regexp_replace(language, r"([\x20-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7E])", r"\\$1")


def extract_code_from_reasoning(text: Column, language: Column) -> Column:
    """first hit wins:
    (a) closed fence tagged with the language (last letter optional),
    (b) closed untagged fence, (c) open tagged fence, (d) open fence,
    (e) text after a reasoning marker (five, in order, case-insensitive),
    (f) the stripped text.  (a)/(b) may return ''; (c)-(e) need non-empty.
    An empty or NULL text is returned as is."""
    esc = _escaped_language(language)
    pat_a = F.concat(F.lit("(?s)```"), esc, F.lit(rf"?{SPACE}*\n(.*?)```"))
    pat_b = F.lit(rf"(?s)```{SPACE}*\n(.*?)```")
    pat_c = F.concat(F.lit("(?s)```"), esc, F.lit(rf"?{SPACE}*\n(.*)"))
    pat_d = F.lit(rf"(?s)```{SPACE}*\n(.*)")

    def like(p):
        return F.call_function("regexp_like", text, p)

    def grab(p):
        return F.call_function("regexp_extract", text, p, F.lit(1))

    trailing_fence = rf"(?md)```{SPACE}*$"
    c_code = F.regexp_replace(py_strip(grab(pat_c)), trailing_fence, "")
    d_code = F.regexp_replace(py_strip(grab(pat_d)), trailing_fence, "")

    out = (F.when(text.isNull() | (text == ""), text)
           .when(like(pat_a), py_strip(grab(pat_a)))
           .when(like(pat_b), py_strip(grab(pat_b)))
           .when(like(pat_c) & (c_code != ""), c_code)
           .when(like(pat_d) & (d_code != ""), d_code))
    for m in map(spelled, THINKING_MARKERS):
        first = F.regexp_extract(text, f"(?is){m}(.*)", 1)
        rest = F.regexp_replace(first, f"(?i){m}", "\n")
        code = py_strip(rest)
        code = F.regexp_replace(code, rf"(?md)^```{WORD}*{SPACE}*\n", "")
        code = F.regexp_replace(code, rf"(?md)\n```{SPACE}*$", "")
        out = out.when(text.rlike(f"(?i){m}") & (code != ""), code)
    return out.otherwise(py_strip(text))


FIRST_BLOCK_PATTERN = spelled(r"(?s)^(.*?```\s*(\w+)?\s*\n.*?\n\s*```)")


def first_fenced_block(text: Column) -> Column:
    """F23 (fenced branch): from the start of the text through the first
    closed fence, stripped; NULL when the text holds no closed fence (the
    caller falls back to the repetition cut, F24)."""
    return F.when(text.rlike(FIRST_BLOCK_PATTERN),
                  py_strip(F.regexp_extract(text, FIRST_BLOCK_PATTERN, 1)))


def _tail(s: Column, start: Column) -> Column:
    """Everything from the 1-based place on."""
    return F.substring(s, start, F.length(s))


def strip_prompt_prefix(output: Column, prompt: Column) -> Column:
    """if the output starts with the prompt: the rest, stripped; else unchanged."""
    return F.when(F.startswith(output, prompt),
                  py_strip(_tail(output, F.length(prompt) + 1))).otherwise(output)


def strip_prompt_contained(output: Column, prompt: Column, strip_unmatched: bool = True) -> Column:
    """text after the first occurrence of the prompt, stripped; otherwise
    the whole output stripped (``strip_unmatched=False``: left as is)."""
    pos = F.instr(output, prompt)
    after = _tail(output, pos + F.length(prompt))
    other = py_strip(output) if strip_unmatched else output
    return F.when(pos > 0, py_strip(after)).otherwise(other)


def extraction_guard(original: Column, extracted: Column) -> Column:
    """use the extraction only if non-blank and different, else the original."""
    ok = extracted.isNotNull() & (py_strip(extracted) != "") & (extracted != original)
    return F.when(ok, extracted).otherwise(original)
