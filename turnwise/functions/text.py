"""Text columns: trimming, word patterns, opening-message features, shingles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise import fixed

# Unicode word edges written out, since \b differs between regex engines.
EDGE_BEFORE = r"(?:^|[^\p{L}\p{N}_])"
EDGE_AFTER = r"(?:$|[^\p{L}\p{N}_])"
WORD_CHAR = r"[\p{L}\p{N}_]"
# Every character Python calls whitespace; the same class text works in RE2.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def word_pattern(words: Sequence[str]) -> str:
    """Any of ``words`` anywhere, as whole words, in any case."""
    return f"(?i){EDGE_BEFORE}(?:{'|'.join(words)}){EDGE_AFTER}"


def opening_pattern(words: Sequence[str]) -> str:
    """Text that opens with one of ``words``, in any case."""
    return f"(?i)^{SPACE}*(?:{'|'.join(words)}){EDGE_AFTER}"


def path_pattern(extensions: Sequence[str]) -> str:
    """A slashed path, or a file name with a known extension."""
    slashed = r"[\p{L}\p{N}_.\-]+/[\p{L}\p{N}_.\-/]+"
    named = rf"{WORD_CHAR}[\p{{L}}\p{{N}}_\-]*\.(?:{'|'.join(extensions)}){EDGE_AFTER}"
    return f"(?:{slashed}|{named})"


PATTERNS = {
    "has_path": path_pattern(fixed.PATH_EXTENSIONS),
    "has_constraint": word_pattern(fixed.CONSTRAINT_WORDS),
    "has_done_criterion": word_pattern(fixed.DONE_WORDS),
    "mentions_plan": word_pattern(fixed.PLAN_WORDS),
    "question": opening_pattern(fixed.QUESTION_OPENERS),
    "correction": opening_pattern(fixed.CORRECTION_OPENINGS),
    "not_correction": opening_pattern(fixed.CORRECTION_EXCLUSIONS),
    "test_command": word_pattern(fixed.TEST_COMMANDS).replace("(?i)", "", 1),
    "commit_command": rf"{EDGE_BEFORE}git{SPACE}+commit{EDGE_AFTER}",
}


def trim_start(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+", "")


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Runs of whitespace become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty text has none."""
    flat = collapse(text)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(trim_start(text) == "", F.lit(True))


def opens_like_correction(
    text: Column,
    turn_no: Column,
    openings: Sequence[str] = fixed.CORRECTION_OPENINGS,
    exclusions: Sequence[str] = fixed.CORRECTION_EXCLUSIONS,
) -> Column:
    """A follow-up turn whose opening reads like pushback."""
    head = trim_start(text)
    return (
        (turn_no > 1)
        & head.rlike(opening_pattern(openings))
        & ~head.rlike(opening_pattern(exclusions))
    )


def first_prompt_features(text: Column, patterns: dict[str, str] = PATTERNS) -> dict[str, Column]:
    """What the opening message of a session mentions, by regular expressions alone."""
    t = trim_all(text)
    return {
        "fp_words": F.size(words(text)).cast("bigint"),
        "has_path": t.rlike(patterns["has_path"]),
        "has_constraint": t.rlike(patterns["has_constraint"]),
        "has_done_criterion": t.rlike(patterns["has_done_criterion"]),
        "is_question": t.endswith("?") | t.rlike(patterns["question"]),
        "slash_cmd": t.startswith("/"),
        "mentions_plan": t.rlike(patterns["mentions_plan"]),
    }


def session_kind(first_text: Column) -> Column:
    """``judge`` for sessions opened by the review command, else null."""
    return F.when(F.lower(trim_start(first_text)).startswith(fixed.REVIEW_COMMAND), F.lit("judge"))


def command_class(command: Column, patterns: dict[str, str] = PATTERNS) -> dict[str, Column]:
    return {
        "is_test": F.coalesce(command.rlike(patterns["test_command"]), F.lit(False)),
        "is_commit": F.coalesce(command.rlike(patterns["commit_command"]), F.lit(False)),
    }


def shingles(text: Column, n: int = fixed.SHINGLE_WORDS) -> Column:
    """Distinct n-word runs as 64-bit identities; empty for shorter texts."""
    def runs(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))

    # Binding the word list to a lambda variable splits each text only once.
    return F.array_distinct(F.flatten(F.transform(F.array(words(F.lower(text))), runs)))


def strip_harness(text: Column) -> Column:
    """Remove reminder blocks and tagged harness blocks."""
    tag = fixed.REMINDER_TAG
    without = F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", " ")
    return F.regexp_replace(without, rf"(?s)<({'|'.join(fixed.HARNESS_TAGS)})>.*?</\1>", " ")


def fingerprint(text: Column) -> Column:
    """12 hexadecimal digits naming a text up to case and spacing."""
    return F.substring(F.sha1(collapse(F.lower(F.coalesce(text, F.lit("")))).cast("binary")), 1, 12)


def basename(path: Column) -> Column:
    """Last path part, ignoring trailing slashes; the path itself if that is empty."""
    tail = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.when(tail == "", path).otherwise(tail)


def shown_branch(branch: Column) -> Column:
    """Branch label, hidden when detached or unknown."""
    return F.when(~branch.isin("HEAD", ""), branch)
