"""Conversations as prompts: chat formats, label masks, graph placeholders, splicing.

turns is (conv_id, turn, role, text); a conversation's turns are put in order inside its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_list

GRAPH, GRAPH_TOKEN, IGNORED, BOS = "<graph>", "-200", "-100", "<s>"
#: Fixed value: what the v1 chat format says first.
SYSTEM = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
#: Each format's opening, text around a user's turn, text around an assistant's turn, and what asks for an answer.
FORMATS = {
    "vicuna": (SYSTEM + " ", "USER: ", "", " ASSISTANT:", "</s>", " ASSISTANT:"),
    "mistral": ("", "[INST] ", " [/INST]", "", "</s>", ""),
    "llama3": ("", "<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n"),
    "qwen3": ("", "<|im_start|>user\n", "<|im_end|>\n", "<|im_start|>assistant\n<think>\n\n</think>\n\n", "<|im_end|>\n", "<|im_start|>assistant\n<think>\n\n</think>\n\n"),
}
FORMATS |= {"llama": FORMATS["vicuna"], "qwen3_moe": FORMATS["qwen3"]}
#: The first of these that a model's name holds, in lower case, tells its format.
FAMILIES = [("qwen3_moe", "qwen3_moe"), ("qwen3-30b", "qwen3_moe"), ("a3b", "qwen3_moe"), ("qwen3", "qwen3"), ("mistral", "mistral"), ("llama-3", "llama3"), ("llama3", "llama3"), ("llama", "vicuna"), ("vicuna", "vicuna")]


#: What named templates say first.
HUMAN_SYSTEM = "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."
TAG_SYSTEM = "A chat between a curious user and an artificial intelligence assistant. The assistant is able to understand the graph content that the user provides, and assist the user with a variety of tasks using natural language.The graph content will be provided with the following format: <Graph>graph content</Graph>."
SAFE_SYSTEM = """You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.

If a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information."""
VISION_SYSTEM = "You are a helpful language and vision assistant. You are able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language."
GRAPH_SYSTEM = "You are a helpful language and graph assistant. You are able to understand the graph content that the user provides, and assist the user with a variety of tasks using natural language."
MPT_SYSTEM = "<|im_start|>system\nA conversation between a user and an LLM-based AI assistant. The assistant gives helpful and honest answers."
#: Named templates' style, system, roles, separator and second separator.
TEMPLATES = {
    "v0": ("single", HUMAN_SYSTEM, ("Human", "Assistant"), "###", ""),
    "v1": ("two", SYSTEM, ("USER", "ASSISTANT"), " ", "</s>"),
    "llama_2": ("llama2", SAFE_SYSTEM, ("USER", "ASSISTANT"), "<s>", "</s>"),
    "plain": ("plain", "", ("", ""), "</s>", ""),
    "llava_v0": ("single", HUMAN_SYSTEM, ("Human", "Assistant"), "###", ""),
    "v0_mmtag": ("single", TAG_SYSTEM, ("Human", "Assistant"), "###", ""),
    "llava_v1": ("two", HUMAN_SYSTEM, ("USER", "ASSISTANT"), " ", "</s>"),
    "v1_mmtag": ("two", TAG_SYSTEM, ("USER", "ASSISTANT"), " ", "</s>"),
    "llava_llama_2": ("llama2", VISION_SYSTEM, ("USER", "ASSISTANT"), "<s>", "</s>"),
    "graph_llama_2": ("llama2", GRAPH_SYSTEM, ("USER", "ASSISTANT"), "<s>", "</s>"),
    "mpt": ("mpt", MPT_SYSTEM, ("<|im_start|>user\n", "<|im_start|>assistant\n"), "<|im_end|>", ""),
}
TEMPLATES |= {"default": TEMPLATES["v0"], "vicuna_v1": TEMPLATES["v1"], "v0_plain": TEMPLATES["plain"]}
#: The turns that one template begins with, of the first role and the second.
EXAMPLES = {
    "v0": (
        "What are the key differences between renewable and non-renewable energy sources?",
        "Renewable energy sources are those that can be replenished naturally in a relatively short amount of time, such as solar, wind, hydro, geothermal, and biomass. Non-renewable energy sources, on the other hand, are finite and will eventually be depleted, such as coal, oil, and natural gas. Here are some key differences between renewable and non-renewable energy sources:\n"
        "1. Availability: Renewable energy sources are virtually inexhaustible, while non-renewable energy sources are finite and will eventually run out.\n"
        "2. Environmental impact: Renewable energy sources have a much lower environmental impact than non-renewable sources, which can lead to air and water pollution, greenhouse gas emissions, and other negative effects.\n"
        "3. Cost: Renewable energy sources can be more expensive to initially set up, but they typically have lower operational costs than non-renewable sources.\n"
        "4. Reliability: Renewable energy sources are often more reliable and can be used in more remote locations than non-renewable sources.\n"
        "5. Flexibility: Renewable energy sources are often more flexible and can be adapted to different situations and needs, while non-renewable sources are more rigid and inflexible.\n"
        "6. Sustainability: Renewable energy sources are more sustainable over the long term, while non-renewable sources are not, and their depletion can lead to economic and social instability.\n",
    )
}
EXAMPLES["default"] = EXAMPLES["v0"]
#: Strings that end an answer in one format or another.
STOPS = ("<|eot_id|>", "<|im_end|>", "</s>")


def stop_ids(vocabulary: dict[str, int], end: str | None = None) -> list[int]:
    """Ids of the end string and of those stops that the vocabulary has, each once."""
    return sorted({vocabulary[s] for s in (end, *STOPS) if s in vocabulary})


def until_stop(tokens: Column) -> Column:
    """Tokens before the first stop."""
    at = F.array_min(F.transform(F.array(*(F.lit(s) for s in STOPS)), lambda s: F.when(F.array_position(tokens, s) > 0, F.array_position(tokens, s))))
    return F.when(at.isNull(), tokens).otherwise(F.slice(tokens, F.lit(1), (at - 1).cast("int")))


def family(model: Column) -> Column:
    """The format's key for a model's name."""
    out = F.lit("vicuna")
    for part, key in reversed(FAMILIES):
        out = F.when(F.contains(F.lower(model), F.lit(part)), F.lit(key)).otherwise(out)
    return out


def role(r: Column) -> Column:
    """human is user, gpt is assistant, others stay."""
    return F.when(r == "human", "user").when(r == "gpt", "assistant").otherwise(r)


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): array of (turn, role, text) by turn."""
    one = F.struct("turn", role(F.col("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("messages"))


def rendered(messages: Column, kind: str, ask: bool = False) -> Column:
    """The prompt in a chat format; roles but user and assistant are left out."""
    opening, user_a, user_b, bot_a, bot_b, end = FORMATS[kind]
    each = F.transform(messages, lambda m: F.when(m["role"] == "user", F.concat(F.lit(user_a), m["text"], F.lit(user_b))).when(m["role"] == "assistant", F.concat(F.lit(bot_a), m["text"], F.lit(bot_b))).otherwise(""))
    return F.concat(F.lit(opening), F.array_join(each, ""), F.lit(end if ask else ""))


def legacy(messages: Column, style: str, system: str = SYSTEM, roles: tuple[str, str] = ("USER", "ASSISTANT"), sep: str = "###", sep2: str = "</s>") -> Column:
    """The prompt in one of five separator styles; system turns are left out, an empty text leaves its role open."""
    said = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    who = lambda m: F.when(m["role"] == "user", roles[0]).otherwise(roles[1])
    turn_sep = lambda i: F.when(i % 2 == 0, sep).otherwise(sep2)
    if style == "single":
        each = lambda m, i: F.concat(who(m), F.when(m["text"] != "", F.concat(F.lit(": "), m["text"], F.lit(sep))).otherwise(":"))
        start = system + sep
    elif style == "two":
        each = lambda m, i: F.concat(who(m), F.when(m["text"] != "", F.concat(F.lit(": "), m["text"], turn_sep(i))).otherwise(":"))
        start = system + sep
    elif style == "mpt":
        each = lambda m, i: F.concat(who(m), F.when(m["text"] != "", F.concat(m["text"], F.lit(sep))).otherwise(""))
        start = system + sep
    elif style == "plain":
        each = lambda m, i: F.when(m["text"] != "", F.concat(m["text"], turn_sep(i))).otherwise("")
        start = system
    elif style == "llama2":
        frame = lambda m, i: F.concat(F.lit("[INST] "), F.when(i == 0, F.lit(f"<<SYS>>\n{system}\n<</SYS>>\n\n")).otherwise(""), m["text"], F.lit(" [/INST]"))
        each = lambda m, i: F.when(m["text"] == "", "").when(i % 2 == 0, F.concat(F.when(i == 0, "").otherwise(sep), frame(m, i))).otherwise(F.concat(F.lit(" "), m["text"], F.lit(" " + sep2)))
        start = ""
    else:
        raise ValueError(style)
    return F.concat(F.lit(start), F.array_join(F.transform(said, each), ""))


def by_template(messages: Column, name: str) -> Column:
    """The prompt in a named template; one begins with an example."""
    style, system, roles, sep, sep2 = TEMPLATES[name]
    shown = "".join(f"{sep}{who}: {text}" for who, text in zip(roles, EXAMPLES.get(name, ())))
    return legacy(messages, style, system + shown, roles, sep, sep2)


def tokens_and_labels(messages: Column) -> Column:
    """Array of (token, label): words, with each graph mark in a user's turn as one placeholder; only an assistant's words are labels."""

    def of(m):
        text = F.when(m["role"] == "user", F.replace(m["text"], F.lit(GRAPH), F.lit(f" {GRAPH_TOKEN} "))).otherwise(m["text"])
        return F.transform(word_list(text), lambda w: F.struct(w.alias("token"), F.when(m["role"] == "assistant", w).otherwise(IGNORED).alias("label")))

    return F.flatten(F.transform(messages, of))


def spliced(prompt: Column) -> Column:
    """Words with the sentinel where the prompt marks a graph, and one opening token."""
    pieces = F.transform(F.split(prompt, GRAPH), word_list)
    joined = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.array(F.lit(GRAPH_TOKEN)), p)))
    return F.concat(F.array(F.lit(BOS)), F.flatten(joined))


def expanded(tokens: Column, graph: Column, pad: int = -500) -> Column:
    """The sentinel replaced by the graph's ids, without pads, each as n<id>."""
    ids = F.transform(F.filter(graph, lambda x: x != pad), lambda x: F.concat(F.lit("n"), x.cast("string")))
    return F.flatten(F.transform(tokens, lambda t: F.when(t == GRAPH_TOKEN, ids).otherwise(F.array(t))))


def with_graphs(pairs: Column, graphs: Column, pads_seen: bool = False, pad: int = -500) -> Column:
    """Array of (token, label, seen) from an array of (token, label): the k-th sentinel gives way to the k-th graph's ids.

    A graph's ids are not labels, its pads stay in place and are seen only if pads_seen; a sentinel
    beyond the graphs gives way to nothing. Null counts as no graphs.
    """
    # one entry a sentinel: the places are looked up among sentinels only
    places = F.filter(F.transform(pairs, lambda p, i: F.when(p["token"] == GRAPH_TOKEN, i)), lambda i: i.isNotNull())
    node = lambda x: F.struct(F.concat(F.lit("n"), x.cast("string")).alias("token"), F.lit(IGNORED).alias("label"), (F.lit(pads_seen) | (x != pad)).alias("seen"))

    def of(p, i):
        graph = F.get(graphs, (F.array_position(places, i) - 1).cast("int"))
        own = F.array(F.struct(p["token"].alias("token"), p["label"].alias("label"), F.lit(True).alias("seen")))
        return F.when(p["token"] == GRAPH_TOKEN, F.coalesce(F.transform(graph, node), F.slice(F.transform(F.array(F.lit(pad).cast("long")), node), 1, 0))).otherwise(own)

    return F.flatten(F.transform(pairs, of))


def with_separators(graph: Column, hops: int, width: int) -> Column:
    """A tree's ids as strings with marks before, between and after its hops."""
    parts, at = [F.array(F.lit("[hop0]"))], 1
    for hop in range(hops + 1):
        parts += [F.transform(F.slice(graph, at, width**hop), lambda x: x.cast("string")), F.array(F.lit(f"[hop{hop + 1}]"))]
        at += width**hop
    return F.concat(*parts)


def tail(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) > n, F.slice(tokens, -n, n)).otherwise(tokens)


def shifted(tokens: Column) -> Column:
    """(token, next) of every token but the last."""
    return F.when(F.size(tokens) > 1, F.arrays_zip(F.slice(tokens, 1, F.size(tokens) - 1).alias("token"), F.slice(tokens, 2, F.size(tokens)).alias("next"))).otherwise(F.array().cast("array<struct<token:string,next:string>>"))


def signed_length(messages: Column, graph_size: Column) -> Column:
    """Words of all turns, and the graph's size with it where there is one; negative without a graph."""
    n = F.aggregate(messages, F.lit(0), lambda s, m: s + F.size(word_list(m["text"])))
    return F.when(graph_size > 0, n + graph_size).otherwise(-n)
