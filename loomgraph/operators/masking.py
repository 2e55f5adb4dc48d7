"""Labels for prompts in the older formats: what is supervised is found again in the rendered prompt.

A prompt is cut into pieces (words, and marks by themselves), and labels are the pieces that the
model should learn to say; the others are IGNORED. Rounds are found by their separators, and
counted: where the pieces of the rounds do not add up to the prompt's, the whole sample is ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chat import BOS, GRAPH, GRAPH_TOKEN, IGNORED

#: Marks that are pieces by themselves, and words between spaces and marks.
PIECE = r"<graph>|<\|[a-z_]+\|>|</?s>|\[/?INST\]|<</?SYS>>|###|[^ \t\n\r\x0b\x0c<\[#]+|[<\[#]"
#: Fixed value: pieces that a tokenizer adds around an instruction by itself, its opening one among them.
AROUND = 2


def pieces(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.when(p == GRAPH, GRAPH_TOKEN).otherwise(p))


def count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)))


def cut(text: Column, mark: str) -> Column:
    return F.split(text, f"\\Q{mark}\\E", -1)


def from_user(messages: Column) -> Column:
    """The turns of user and assistant, without a first one that is not the user's."""
    said = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    return F.when((F.size(said) > 0) & (F.get(said, F.lit(0))["role"] != "user"), F.slice(said, F.lit(2), F.size(said))).otherwise(said)


def _ignored(n: Column) -> Column:
    return F.array_repeat(F.lit(IGNORED), F.greatest(n, F.lit(0)).cast("int"))


def _pairs(tokens: Column, labels: Column) -> Column:
    """Array of (token, label), as many as tokens; labels that lack are ignored."""
    return F.zip_with(tokens, F.slice(labels, F.lit(1), F.size(tokens)), lambda t, x: F.struct(t.alias("token"), F.coalesce(x, F.lit(IGNORED)).alias("label")))


def _by_rounds(tokens: Column, rounds: Column, asked: str, first: int, size: Callable[[Column], Column], told: Callable[[Column], Column]) -> Column:
    """Labels of rounds that follow one another from place first: size(round) pieces each, of which told(what precedes and holds asked) are ignored.

    Rounds count up to the first that is empty or has not exactly one asked in it.
    """
    bad = F.transform(rounds, lambda r, i: F.when((r == "") | (F.size(cut(r, asked)) != 2), i))
    good = F.slice(rounds, F.lit(1), F.coalesce(F.array_min(bad), F.size(rounds)))
    each = F.transform(good, lambda r: F.struct(size(r).alias("n"), F.greatest(F.lit(0), told(F.concat(F.get(cut(r, asked), F.lit(0)), F.lit(asked)))).alias("m")))
    ends = F.transform(each, lambda r, i: F.aggregate(F.slice(each, F.lit(1), i + 1), F.lit(first), lambda s, x: s + x["n"]))
    # A few rounds a conversation: their sums are taken anew for each.
    labels = F.transform(each, lambda r, i: F.concat(_ignored(r["m"]), F.slice(tokens, F.get(ends, i) - r["n"] + r["m"] + 1, F.greatest(F.lit(0), r["n"] - r["m"]))))
    whole = F.concat(_ignored(F.lit(first)), F.flatten(labels))
    stop = F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(first))
    return F.when(stop == F.size(tokens), whole).otherwise(_ignored(F.size(tokens)))


def instruction_labels(prompt: Column, asked: str = "[/INST] ", end: str = "</s>", around: int = AROUND) -> Column:
    """(token, label) of a prompt whose rounds end with end; in a round, what stands up to asked is ignored."""
    tokens = F.concat(F.array(F.lit(BOS)), pieces(prompt))
    return _pairs(tokens, _by_rounds(tokens, cut(prompt, end), asked, 1, lambda r: count(r) + 1, lambda x: count(x) + 1 - around))


def turn_labels(prompt: Column, end: str = "<|im_end|>", bot: str = "<|im_start|>assistant\n") -> Column:
    """(token, label) of a prompt whose turns end with end: the system, user and assistant make the first round, two turns each further one."""
    turns = cut(prompt, end)
    n = F.size(turns)
    later = F.when(n > 3, F.transform(F.sequence(F.lit(4), n, F.lit(2)), lambda i: F.array_join(F.slice(turns, i, F.lit(2)), end))).otherwise(F.array().cast("array<string>"))
    rounds = F.concat(F.array(F.array_join(F.slice(turns, F.lit(1), F.lit(3)), end)), later)
    return _pairs(pieces(prompt), _by_rounds(pieces(prompt), rounds, end + bot, 0, lambda r: count(r) + 1, count))


def marker_labels(prompt: Column, marker: str = "ASSISTANT:", end: str = "</s>") -> Column:
    """(token, label) of a prompt in which the assistant speaks from marker to end, the end included, so that a model learns to stop; or to the prompt's end."""
    tokens = F.concat(F.array(F.lit(BOS)), pieces(prompt))
    closes = F.filter(F.transform(tokens, lambda t, i: F.when(t == end, i)), lambda i: i.isNotNull())
    bounds = F.concat(F.array(F.lit(-1)), closes, F.array(F.size(tokens) - 1))
    stretch = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda k: F.slice(tokens, F.get(bounds, k - 1) + 2, F.get(bounds, k) - F.get(bounds, k - 1)))
    labels = F.transform(stretch, lambda s: F.when(F.array_position(s, marker) > 0, F.concat(_ignored(F.array_position(s, marker)), F.slice(s, F.array_position(s, marker).cast("int") + 1, F.size(s)))).otherwise(_ignored(F.size(s))))
    return _pairs(tokens, F.flatten(labels))


def speaker_labels(messages: Column, system: str, roles: tuple[str, str] = ("Human", "Assistant")) -> Column:
    """(token, label) of turns that are each introduced by their speaker: of a user's turn all but two pieces are ignored, and the system's text.

    Each turn is counted by itself, with the opening piece that a tokenizer gives it.
    """
    who = lambda m: F.when(m["role"] == "user", roles[0]).when(m["role"] == "assistant", roles[1]).otherwise("unknown")
    said = F.transform(messages, lambda m: F.concat(F.lit("### "), who(m), F.lit(": "), m["text"], F.lit("\n")))
    header = F.lit(f"{system}\n\n")
    tokens = F.concat(F.array(F.lit(BOS)), pieces(F.concat(header, F.array_join(said, ""), F.lit("### "))))
    size = F.transform(said, lambda s: count(s) + 1)
    start = lambda i: F.aggregate(F.slice(size, F.lit(1), i), count(header) + 1, lambda s, x: s + x)
    part = lambda m, i: F.when(m["role"] == "user", F.concat(F.slice(tokens, start(i) + 1, F.lit(2)), _ignored(F.get(size, i) - 2))).otherwise(F.slice(tokens, start(i) + 1, F.get(size, i)))
    turns = F.flatten(F.transform(messages, part))
    stop = start(F.size(size))
    rest = F.when(stop < F.size(tokens), F.slice(tokens, stop + 1, F.size(tokens))).otherwise(F.array().cast("array<string>"))
    return _pairs(tokens, F.concat(_ignored(count(header) + 1), turns, rest))
