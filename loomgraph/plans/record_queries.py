"""Queries on texts, prompts, conversations, answers and batches, each with the SQL that states it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine, rounded
from ..operators import batching as B
from ..operators import chat as H
from ..operators import graph as G
from ..operators import masking as M
from ..operators import prompts as P
from ..operators import scoring as S
from ..session import scratch_root, stash
from ..sources import catalog
from ..sources import tables as T
from . import sql as Q
from .graph_queries import DIM, centers, fixed_edges, ids, joined_ids
from .registry import query


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# -- texts and prompts ----------------------------------------------------------------------


def bare_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with raw text, or none: then title and abstract, or blanks. Title and abstract hold the whole text."""
    n = T.nodes(spark, d)
    whole = F.coalesce("text", F.lit(""))
    first, rest = F.substring(whole, 1, 20), F.when(F.col("id") % 2 == 0, F.substring(whole, F.lit(21), F.length(whole))).otherwise(whole)
    return n.select("id", "y", F.when(F.col("id") % 3 == 0, F.col("text")).when(F.col("id") % 3 == 1, F.lit("  ")).alias("raw"), F.when(F.col("id") % 2 == 0, first).otherwise("").alias("title"), rest.alias("abstract"))


BARE = "bare AS MATERIALIZED (SELECT id, y, CASE WHEN id % 3 = 0 THEN text WHEN id % 3 = 1 THEN '  ' END AS raw, CASE WHEN id % 2 = 0 THEN substr(coalesce(text, ''), 1, 20) ELSE '' END AS title, CASE WHEN id % 2 = 0 THEN substr(coalesce(text, ''), 21) ELSE coalesce(text, '') END AS abstract FROM nodes)"


@query("assemble_text", Q.with_(Q.NODES, BARE, "t AS (SELECT id, coalesce(raw, 'Title: ' || title || chr(9) || 'Abstract: ' || abstract) AS text FROM bare)") + "SELECT id, CASE WHEN trim(text) = '' THEN ' ' ELSE text END AS text FROM t")
def assemble_text(spark, d):
    return bare_nodes(spark, d).select("id", P.assemble_text(F.col("raw"), F.col("title"), F.col("abstract")).alias("text"))


@query("label_lookup", Q.with_(Q.NODES, "cl AS (SELECT unnest(range(12)) AS y, unnest([" + ", ".join(lit(x) for x in P.CLASSES["history"]) + "]) AS label)") + "SELECT id, y, label FROM nodes JOIN cl USING (y)")
def label_lookup(spark, d):
    classes = spark.createDataFrame(list(enumerate(P.CLASSES["history"])), "y int, label string")
    return T.nodes(spark, d).join(F.broadcast(classes), "y").select("id", "y", "label")


@query("text_prefix", "SELECT doc_id, substr(text, 1, 2000) AS prefix FROM documents")
def text_prefix(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.substring("text", 1, 2000).alias("prefix"))


def _rendered_sql() -> str:
    out = []
    for name in P.WORDING:
        classes = P.LISTED.get(name, P.CLASSES.get(name)) or ["first", "second"]
        parts = [{"{title}": "title", "{abstract}": "abstract", "{text}": "coalesce(raw, '')"}.get(x, lit(x)) for x in P.pieces(name, classes)]
        out.append(f"SELECT {lit(name)} AS dataset, id, {' || '.join(parts)} AS prompt FROM bare")
    return Q.with_(Q.NODES, BARE) + " UNION ALL ".join(out)


@query("prompt_render", _rendered_sql())
def prompt_render(spark, d):
    nodes = bare_nodes(spark, d)
    columns = {"title": F.col("title"), "abstract": F.col("abstract"), "text": F.col("raw")}
    every = [F.struct(F.lit(n).alias("dataset"), P.render(n, columns, None if n in P.CLASSES else ["first", "second"]).alias("prompt")) for n in P.WORDING]
    return nodes.select("id", F.explode(F.array(*every)).alias("p")).select("p.dataset", "id", "p.prompt")


def _class_prompts_sql() -> str:
    out = []
    for name in P.TEXT_WORDING:
        a, b = map(lit, P.class_pieces(name))
        out.append(f"SELECT {lit(name)} AS dataset, id, 'nctext' AS task, {a} || substr(coalesce(text, ''), 1, {P.TEXT_LENGTH}) || {b} AS prompt FROM nodes")
    out.append(f"SELECT 'products' AS dataset, id, 'nc' AS task, {lit(P.class_pieces('products', False)[0])} AS prompt FROM nodes")
    return Q.with_(Q.NODES) + " UNION ALL ".join(out)


@query("class_prompts", _class_prompts_sql())
def class_prompts(spark, d):
    every = [F.struct(F.lit(n).alias("dataset"), F.lit("nctext").alias("task"), P.class_prompt(n, F.col("text")).alias("prompt")) for n in P.TEXT_WORDING]
    every.append(F.struct(F.lit("products").alias("dataset"), F.lit("nc").alias("task"), P.class_prompt("products").alias("prompt")))
    return T.nodes(spark, d).select("id", F.explode(F.array(*every)).alias("p")).select("p.dataset", "id", "p.task", "p.prompt")


TASKS = f"""SELECT id, 'nc' AS task, 'Classify ' || id AS human, y::VARCHAR AS gpt FROM bare
UNION ALL SELECT id, 'lp', {lit(P.CONNECT)}, CASE WHEN y % 2 = 0 THEN 'yes' ELSE 'no' END FROM bare
UNION ALL SELECT id, 'nd', {lit(P.DESCRIBE)}, 'This is a paper in ' || y || ' domain' || CASE WHEN title = '' THEN '' ELSE ', it''s about ' || title || '.' END FROM bare
UNION ALL SELECT id, 'nda', {lit(P.DESCRIBE)}, 'This is a paper in ' || y || ' domain' || CASE WHEN title = '' AND abstract = '' THEN '' WHEN title = '' THEN ', its abstract is ' || abstract || '.' WHEN abstract = '' THEN ', its title is ' || title || '.' ELSE ', its title is ' || title || ', its abstract is ' || abstract || '.' END FROM bare"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    n, y = bare_nodes(spark, d), F.col("y").cast("string")
    answer = {"nc": y, "lp": F.when(F.col("y") % 2 == 0, "yes").otherwise("no"), "nd": P.description("nd", y, F.col("title"), F.col("abstract")), "nda": P.description("nda", y, F.col("title"), F.col("abstract"))}
    own = F.concat(F.lit("Classify "), F.col("id").cast("string"))
    every = [F.struct(F.lit(t).alias("task"), P.task_prompt(t, own).alias("human"), a.alias("gpt")) for t, a in answer.items()]
    return n.select("id", F.explode(F.array(*every)).alias("t")).select("id", "t.*")


@query("task_prompts", Q.with_(Q.NODES, BARE) + TASKS)
def task_prompts(spark, d):
    return tasks(spark, d)


@query("repeat_union", Q.with_(Q.NODES, BARE, f"tk AS ({TASKS})") + "SELECT task, id, r AS repeat FROM tk, range(1, 4) t(r) WHERE task = 'nc' UNION ALL SELECT task, id, 1 FROM tk WHERE task = 'lp'")
def repeat_union(spark, d):
    from ..sources.catalog import parse_spec

    t, out = tasks(spark, d), None
    for name, times in parse_spec("nc.3-lp"):
        one = t.where(F.col("task") == name).select("task", "id", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("repeat"))
        out = one if out is None else out.unionByName(one)
    return out


def prompt_records(spark: SparkSession, d: str) -> DataFrame:
    """(id, graph, conversations): each center with its start neighbours."""
    from ..operators.context import start_neighbors

    graph = start_neighbors(centers(spark, d), fixed_edges(spark, d)).groupBy("center").agg(F.transform(F.array_sort(F.collect_list(F.struct("walk", "id"))), lambda x: x["id"]).alias("graph"))
    human = F.concat(F.lit("Look at <graph> around "), F.col("center").cast("string"), F.lit(" \"now\"."))
    return graph.select(P.record(F.col("center"), F.col("graph"), human, F.lit("class é")).alias("r")).select("r.*")


PROMPTS = "pr AS MATERIALIZED (SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY rk) AS graph, count(*) AS n FROM nbr WHERE rk <= 9 GROUP BY 1)"


@query("json_prompts", Q.with_(*Q.GRAPH, Q.NBR, PROMPTS) + "SELECT id, graph, 2 AS turns, 'Look at <graph> around ' || id || ' \"now\".' AS human, 'class é' AS gpt FROM pr")
def json_prompts(spark, d):
    path = f"{scratch_root(spark)}/loomgraph/prompts-{uuid.uuid4().hex}"
    T.write_prompts(prompt_records(spark, d), path)
    p = T.read_prompts(spark, path)
    return p.select("id", joined_ids("graph").alias("graph"), F.size("conversations").alias("turns"), F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"))


@query("prompts_kept", Q.with_(*Q.GRAPH, Q.NBR, PROMPTS) + "SELECT id, graph FROM pr WHERE id % 2 = 0")
def prompts_kept(spark, d):
    """A file that is there already stays, unless it is to be written anew."""
    path = f"{scratch_root(spark)}/loomgraph/prompts-{uuid.uuid4().hex}"
    p = prompt_records(spark, d)
    for rows, keep in ((p, False), (p.where("id % 2 = 0"), False), (p.where("id % 3 = 0"), True)):
        T.write_prompts(rows, path, skip_if_there=keep)
    return T.read_prompts(spark, path).select("id", joined_ids("graph").alias("graph"))


@query("catalog_views", Q.with_(*Q.GRAPH, Q.NODES) + "SELECT n.id, n.y, n.split, count(ed.dst) AS degree FROM nodes n LEFT JOIN ed ON ed.src = n.id WHERE n.split IN ('train', 'test') GROUP BY 1, 2, 3")
def catalog_views(spark, d):
    """A data set in a catalog's folders, read through its views; of its splits, those that get prompts."""
    root = f"{scratch_root(spark)}/loomgraph/catalog-{uuid.uuid4().hex}"
    c = catalog.Catalog(root)
    nodes = T.nodes(spark, d)
    for name, table in (("nodes", nodes), ("edges", fixed_edges(spark, d)), ("classes", nodes.select("y").distinct())):
        table.write.parquet(c.dataset("arxiv", name))
    c.register(spark, "arxiv")
    degree = spark.table("arxiv_edges").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    own = spark.table("arxiv_nodes").join(spark.table("arxiv_classes"), "y", "left_semi").where(F.col("split").isin(catalog.splits("arxiv")))
    return own.join(degree, "id", "left").select("id", "y", "split", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("answer_ids", Q.with_(Q.answers("n", "n", "n2", "n")) + "SELECT question_id, substr(sha256(question_id::VARCHAR || chr(31) || coalesce(text, '')), 1, 22) AS answer_id FROM an")
def answer_ids(spark, d):
    return T.with_answer_ids(named(spark, d)).select("question_id", "answer_id")


@query("splice_sentinel", Q.with_(*Q.GRAPH, Q.NBR, PROMPTS) + "SELECT id, '<s> Look at -200 around ' || id || ' \"now\".' AS tokens FROM pr")
def splice_sentinel(spark, d):
    p = prompt_records(spark, d)
    return p.select("id", F.array_join(H.spliced(F.col("conversations")[0]["value"]), " ").alias("tokens"))


@query("splice_expand", Q.with_(*Q.GRAPH, Q.NBR, PROMPTS) + "SELECT id, '<s> Look at n' || replace(graph, ',', ' n') || ' around ' || id || ' \"now\".' AS tokens, n + 6 AS n FROM pr")
def splice_expand(spark, d):
    p = prompt_records(spark, d).withColumn("t", H.spliced(F.col("conversations")[0]["value"]))
    full = H.expanded(F.col("t"), F.concat("graph", F.array(F.lit(-500).cast("long"))))
    return p.select("id", F.array_join(full, " ").alias("tokens"), F.size(full).alias("n"))


@query("hop_separators", Q.with_(*Q.GRAPH, Q.NBR, "h AS (SELECT v.id, string_agg(coalesce(dst, -500)::VARCHAR, ' ' ORDER BY r) AS s FROM v CROSS JOIN range(3) t(r) LEFT JOIN nbr ON src = v.id AND rk = r + 1 GROUP BY 1)") + "SELECT id, '[hop0] ' || id || ' [hop1] ' || s || ' [hop2]' AS tokens FROM h")
def hop_separators(spark, d):
    tree = G.hop_tree(centers(spark, d), fixed_edges(spark, d), 1, 3)
    seq = tree.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("g"))
    return seq.select("id", F.array_join(H.with_separators(F.col("g"), 1, 3), " ").alias("tokens"))


# -- conversations --------------------------------------------------------------------------


def turns(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "conversations")


def _chat_sql(kind: str) -> str:
    opening, ua, ub, ba, bb, _ = (lit(x) for x in H.FORMATS[kind])
    each = f"CASE role WHEN 'user' THEN {ua} || text || {ub} WHEN 'assistant' THEN {ba} || text || {bb} ELSE '' END"
    return f"SELECT conv_id, {lit(kind)} AS kind, md5({opening} || string_agg({each}, '' ORDER BY turn, role, text)) AS prompt FROM tn GROUP BY 1"


@query("chat_template", Q.with_(Q.TURNS) + " UNION ALL ".join(_chat_sql(k) for k in H.FORMATS))
def chat_template(spark, d):
    m = H.ordered(turns(spark, d))
    every = [F.struct(F.lit(k).alias("kind"), F.md5(H.rendered(F.col("messages"), k)).alias("prompt")) for k in H.FORMATS]
    return m.select("conv_id", F.explode(F.array(*every)).alias("p")).select("conv_id", "p.*")


def _legacy_sql(style: str, says: str = H.SYSTEM, roles: tuple[str, str] = ("USER", "ASSISTANT"), one: str = "###", two: str = "</s>") -> str:
    sep, system, sep2 = lit(one), lit(says), lit(" " + two)
    turn_sep = f"CASE WHEN i % 2 = 0 THEN {sep} ELSE {lit(two)} END"
    who = f"CASE role WHEN 'user' THEN {lit(roles[0])} ELSE {lit(roles[1])} END"
    each, start = {
        "single": (f"{who} || CASE WHEN text <> '' THEN ': ' || text || {sep} ELSE ':' END", f"{system} || {sep}"),
        "two": (f"{who} || CASE WHEN text <> '' THEN ': ' || text || {turn_sep} ELSE ':' END", f"{system} || {sep}"),
        "mpt": (f"{who} || CASE WHEN text <> '' THEN text || {sep} ELSE '' END", f"{system} || {sep}"),
        "plain": (f"CASE WHEN text <> '' THEN text || {turn_sep} ELSE '' END", system),
        "llama2": (f"CASE WHEN text = '' THEN '' WHEN i % 2 = 0 THEN CASE WHEN i = 0 THEN '' ELSE {sep} END || '[INST] ' || CASE WHEN i = 0 THEN '<<SYS>>' || chr(10) || {system} || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || text || ' [/INST]' ELSE ' ' || text || {sep2} END", "''"),
    }[style]
    return Q.with_(Q.TURNS, "o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM tn WHERE role IN ('user', 'assistant'))", f"j AS (SELECT conv_id, string_agg({each}, '' ORDER BY i) AS s FROM o GROUP BY 1)") + f"SELECT c.conv_id, {start} || coalesce(s, '') AS prompt FROM (SELECT DISTINCT conv_id FROM tn) c LEFT JOIN j USING (conv_id)"


def _legacy(style: str):
    def run(spark, d):
        return H.ordered(turns(spark, d)).select("conv_id", H.legacy(F.col("messages"), style).alias("prompt"))

    return run


for _style in ("single", "two", "llama2", "mpt", "plain"):
    query(f"chat_{_style}", _legacy_sql(_style))(_legacy(_style))


def _named_sql(name: str) -> str:
    style, says, roles, one, two = H.TEMPLATES[name]
    begun = "".join(f"{one}{who}: {text}" for who, text in zip(roles, H.EXAMPLES.get(name, ())))
    return f"SELECT conv_id, {lit(name)} AS template, md5(prompt) AS prompt FROM ({_legacy_sql(style, says + begun, roles, one, two)})"


@query("chat_named", " UNION ALL ".join(map(_named_sql, H.TEMPLATES)))
def chat_named(spark, d):
    m = H.ordered(turns(spark, d))
    every = [F.struct(F.lit(name).alias("template"), F.md5(H.by_template(F.col("messages"), name)).alias("prompt")) for name in H.TEMPLATES]
    return m.select("conv_id", F.explode(F.array(*every)).alias("p")).select("conv_id", "p.*")


@query("role_map", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE role END AS role, CASE WHEN role = 'user' THEN replace('<graph> ' || text, '<graph>', '-200') ELSE '<graph> ' || text END AS text FROM conversations")
def role_map(spark, d):
    t = turns(spark, d).select("conv_id", "turn", F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")).alias("said"), F.concat(F.lit("<graph> "), F.col("text")).alias("text"))
    r = H.role(F.col("said"))
    return t.select("conv_id", "turn", r.alias("role"), F.when(r == "user", F.replace("text", F.lit(H.GRAPH), F.lit(H.GRAPH_TOKEN))).otherwise(F.col("text")).alias("text"))


WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: w <> '')"


def _words(x: str) -> str:
    return WORDS.format(x)


TOKENS = f"""tk AS MATERIALIZED (SELECT conv_id, turn, role, text, unnest({_words('text')}) AS token, generate_subscripts({_words('text')}, 1) AS k FROM (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN replace(text, '<graph>', ' -200 ') ELSE text END AS text FROM (SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN 'See <graph>, ' || text ELSE text END AS text FROM tn)))"""


def marked(spark, d) -> DataFrame:
    """Conversations whose first turn mentions a graph."""
    t = turns(spark, d)
    return H.ordered(t.withColumn("text", F.when(F.col("turn") == 0, F.concat(F.lit("See <graph>, "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))))


@query("mask_labels", Q.with_(Q.TURNS, TOKENS) + "SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'assistant') AS supervised, md5(string_agg(token, ' ' ORDER BY turn, role, text, k)) AS tokens, md5(string_agg(CASE WHEN role = 'assistant' THEN token ELSE '-100' END, ' ' ORDER BY turn, role, text, k)) AS labels FROM tk GROUP BY 1")
def mask_labels(spark, d):
    t = marked(spark, d).select("conv_id", H.tokens_and_labels(F.col("messages")).alias("t")).where(F.size("t") > 0)
    join = lambda f: F.md5(F.array_join(F.transform("t", lambda x: x[f]), " "))
    return t.select("conv_id", F.size("t").alias("n"), F.size(F.filter("t", lambda x: x["label"] != H.IGNORED)).alias("supervised"), join("token").alias("tokens"), join("label").alias("labels"))


# -- labels of the older formats ------------------------------------------------------------


def _led_sql(style: str) -> str:
    """CTEs ending in pr(conv_id, prompt): conversations with a graph mark, from the user's first turn on."""
    return _legacy_sql(style, *_style_words(style)).replace(Q.TURNS, f"{Q.TURNS}, mk AS (SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN 'See <graph>, ' || text ELSE text END AS text FROM tn)").replace(
        "FROM tn WHERE role IN ('user', 'assistant'))", "FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ix FROM mk WHERE role IN ('user', 'assistant')) WHERE ix > 1 OR role = 'user')"
    )


def _style_words(style: str) -> tuple[str, tuple[str, str], str, str]:
    return next(t[1:] for t in H.TEMPLATES.values() if t[0] == style)


def _pieces(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(M.PIECE)})"


LABELS = "SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE label <> '-100') AS supervised, md5(string_agg(token, ' ' ORDER BY k)) AS tokens, md5(string_agg(label, ' ' ORDER BY k)) AS labels FROM lb GROUP BY 1"
AS_TOKEN = "CASE WHEN token = '<graph>' THEN '-200' ELSE token END"


def _rounds_sql(style: str, rounds: str, asked: str, first: int, size: str, told: str) -> str:
    """rounds ends in rd(conv_id, i, r); size and told speak of r and of what precedes, p."""
    start = f"list_concat(['<s>'], {_pieces('prompt')})" if first else _pieces("prompt")
    return Q.with_(
        f"pr AS MATERIALIZED ({_led_sql(style)})",
        f"ts AS MATERIALIZED (SELECT conv_id, {start} AS t FROM pr)",
        rounds,
        f"fl AS (SELECT *, r = '' OR len(string_split(r, {lit(asked)})) <> 2 AS bad, string_split(r, {lit(asked)})[1] || {lit(asked)} AS p FROM rd)",
        "gd AS (SELECT * FROM fl WHERE i < coalesce((SELECT min(i) FROM fl x WHERE x.conv_id = fl.conv_id AND bad), 1000000))",
        f"ln AS (SELECT conv_id, i, {size} AS n, greatest(0, {told}) AS m FROM gd)",
        f"st AS MATERIALIZED (SELECT *, {first} + sum(n) OVER (PARTITION BY conv_id ORDER BY i) - n AS s, {first} + sum(n) OVER (PARTITION BY conv_id) AS stop FROM ln)",
        "tk AS (SELECT conv_id, len(t) AS total, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS k FROM ts)",
        f"lb AS (SELECT tk.conv_id, k, {AS_TOKEN} AS token, CASE WHEN s IS NOT NULL AND stop = total THEN {AS_TOKEN} ELSE '-100' END AS label FROM tk LEFT JOIN st ON st.conv_id = tk.conv_id AND k >= s + m AND k < s + n)",
    ) + LABELS


def _cut_sql(column: str, mark: str) -> str:
    return f"SELECT conv_id, unnest(string_split({column}, {lit(mark)})) AS r, generate_subscripts(string_split({column}, {lit(mark)}), 1) AS i FROM pr"


MASKED = {
    "instructions": ("llama2", _rounds_sql("llama2", f"rd AS ({_cut_sql('prompt', '</s>')})", "[/INST] ", 1, f"len({_pieces('r')}) + 1", f"len({_pieces('p')}) - 1"), M.instruction_labels),
    "turns": ("mpt", _rounds_sql("mpt", f"tu AS ({_cut_sql('prompt', '<|im_end|>')}), rd AS (SELECT conv_id, greatest(0, (i - 2) // 2) AS i, string_agg(r, '<|im_end|>' ORDER BY i) AS r FROM tu GROUP BY 1, 2)", "<|im_end|><|im_start|>assistant\n", 0, f"len({_pieces('r')}) + 1", f"len({_pieces('p')})"), M.turn_labels),
    "marker": ("two", Q.with_(
        f"pr AS MATERIALIZED ({_led_sql('two')})",
        f"ts AS MATERIALIZED (SELECT conv_id, list_concat(['<s>'], {_pieces('prompt')}) AS t FROM pr)",
        "tk AS (SELECT conv_id, unnest(t) AS token, generate_subscripts(t, 1) AS k FROM ts)",
        "ev AS (SELECT *, coalesce(max(CASE WHEN token = 'ASSISTANT:' THEN k END) OVER w, 0) AS said, coalesce(max(CASE WHEN token = '</s>' THEN k END) OVER w, 0) AS closed FROM tk WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        f"lb AS (SELECT conv_id, k, {AS_TOKEN} AS token, CASE WHEN said > closed THEN {AS_TOKEN} ELSE '-100' END AS label FROM ev)",
    ) + LABELS, M.marker_labels),
}


def led(spark, d) -> DataFrame:
    return marked(spark, d).select("conv_id", M.from_user(F.col("messages")).alias("messages"))


def labelled(df: DataFrame) -> DataFrame:
    join = lambda f: F.md5(F.array_join(F.transform("t", lambda x: x[f]), " "))
    return df.select("conv_id", F.size("t").cast("long").alias("n"), F.size(F.filter("t", lambda x: x["label"] != H.IGNORED)).cast("long").alias("supervised"), join("token").alias("tokens"), join("label").alias("labels"))


def _masked(style: str, labels):
    def run(spark, d):
        prompts = led(spark, d).select("conv_id", H.legacy(F.col("messages"), style, *_style_words(style)).alias("prompt"))
        return labelled(prompts.select("conv_id", labels(F.col("prompt")).alias("t")))

    return run


for _name, (_kind, _sql, _labels) in MASKED.items():
    query(f"mask_{_name}", _sql)(_masked(_kind, _labels))

SPOKEN = f"""mk AS (SELECT conv_id, role, CASE WHEN turn = 0 THEN 'See <graph>, ' || text ELSE text END AS text, turn FROM tn),
ld AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ix FROM mk WHERE role IN ('user', 'assistant')) WHERE ix > 1 OR role = 'user'),
sd AS MATERIALIZED (SELECT conv_id, ix, role, '### ' || CASE role WHEN 'user' THEN 'Human' ELSE 'Assistant' END || ': ' || text || chr(10) AS s FROM ld),
hd AS (SELECT {lit(H.HUMAN_SYSTEM)} || chr(10) || chr(10) AS h), hn AS (SELECT len({_pieces('h')}) + 1 AS first FROM hd),
ts AS (SELECT c.conv_id, list_concat(['<s>'], {_pieces("(SELECT h FROM hd) || coalesce(s, '') || '### '")}) AS t FROM (SELECT DISTINCT conv_id FROM tn) c LEFT JOIN (SELECT conv_id, string_agg(s, '' ORDER BY ix) AS s FROM sd GROUP BY 1) j USING (conv_id)),
st AS MATERIALIZED (SELECT conv_id, role, n, first + sum(n) OVER (PARTITION BY conv_id ORDER BY ix) - n AS s FROM (SELECT *, len({_pieces('s')}) + 1 AS n FROM sd), hn),
tk AS (SELECT conv_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS k FROM ts),
lb AS (SELECT tk.conv_id, k, {AS_TOKEN} AS token, CASE WHEN k < first OR (st.role = 'user' AND k >= s + 2) THEN '-100' ELSE {AS_TOKEN} END AS label FROM tk CROSS JOIN hn LEFT JOIN st ON st.conv_id = tk.conv_id AND k >= s AND k < s + n)"""


@query("mask_speakers", Q.with_(Q.TURNS, SPOKEN) + LABELS)
def mask_speakers(spark, d):
    return labelled(led(spark, d).select("conv_id", M.speaker_labels(F.col("messages"), H.HUMAN_SYSTEM).alias("t")))


SPLICED = """sp AS MATERIALIZED (SELECT conv_id, turn, role, text, k, j, token, CASE WHEN j IS NULL AND role = 'assistant' THEN token ELSE '-100' END AS label, token <> 'n-500' AS seen
 FROM (SELECT conv_id, turn, role, text, k, NULL AS j, token FROM tk WHERE token <> '-200' UNION ALL SELECT conv_id, turn, role, text, k, j, CASE j WHEN 0 THEN 'n' || conv_id WHEN 1 THEN 'n' || (conv_id + 1) ELSE 'n-500' END FROM tk, range(3) t(j) WHERE token = '-200')),
ro AS MATERIALIZED (SELECT conv_id, list(token ORDER BY turn, role, text, k, j) AS t, list(label ORDER BY turn, role, text, k, j) AS l, list(CASE WHEN seen THEN '1' ELSE '0' END ORDER BY turn, role, text, k, j) AS s FROM sp GROUP BY 1),
ba AS (SELECT *, (row_number() OVER (ORDER BY conv_id) - 1) // 8 AS batch FROM ro), mx AS MATERIALIZED (SELECT *, max(len(t)) OVER (PARTITION BY batch) AS n FROM ba)"""


def _filled(column: str, value: str) -> str:
    return f"md5(array_to_string(list_concat({column}, list_transform(range(n - len({column})), lambda x: '{value}')), ' '))"


@query("splice_batches", Q.with_(Q.TURNS, TOKENS, SPLICED) + f"SELECT conv_id, batch, n, {_filled('t', '<pad>')} AS tokens, {_filled('l', '-100')} AS labels, {_filled('s', '0')} AS mask FROM mx")
def splice_batches(spark, d):
    graph = F.array(F.col("conv_id").cast("long"), F.col("conv_id") + 1, F.lit(-500).cast("long"))
    t = marked(spark, d).select("conv_id", H.tokens_and_labels(F.col("messages")).alias("t")).where(F.size("t") > 0)
    b = B.pad_spliced(t.select(F.col("conv_id").alias("id"), H.with_graphs(F.col("t"), F.array(graph)).alias("pieces")), 8)
    join = lambda c: F.md5(F.array_join(c, " "))
    return b.select(F.col("id").alias("conv_id"), "batch", F.size("tokens").alias("n"), join("tokens").alias("tokens"), join("labels").alias("labels"), join(F.transform("mask", lambda x: x.cast("int").cast("string"))).alias("mask"))


FLAT = "fl AS MATERIALIZED (SELECT conv_id, list(token ORDER BY turn, role, text, k) AS t FROM tk GROUP BY 1)"


def flat_tokens(spark, d) -> DataFrame:
    return marked(spark, d).select("conv_id", F.transform(H.tokens_and_labels(F.col("messages")), lambda x: x["token"]).alias("t")).where(F.size("t") > 0)


@query("truncate_tail", Q.with_(Q.TURNS, TOKENS, FLAT) + "SELECT conv_id, array_to_string(t[greatest(1, len(t) - 15):], ' ') AS tail FROM fl")
def truncate_tail(spark, d):
    return flat_tokens(spark, d).select("conv_id", F.array_join(H.tail(F.col("t"), 16), " ").alias("tail"))


@query("shift_labels", Q.with_(Q.TURNS, TOKENS, FLAT) + "SELECT conv_id, len(t) - 1 AS n, md5(array_to_string(t[:-2], ' ')) AS inputs, md5(array_to_string(t[2:], ' ')) AS targets FROM fl WHERE len(t) > 1")
def shift_labels(spark, d):
    t = flat_tokens(spark, d).select("conv_id", H.shifted(F.col("t")).alias("s")).where(F.size("s") > 0)
    join = lambda f: F.md5(F.array_join(F.transform("s", lambda x: x[f]), " "))
    return t.select("conv_id", F.size("s").alias("n"), join("token").alias("inputs"), join("next").alias("targets"))


LENGTHS = f"ln AS MATERIALIZED (SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN n + 9 ELSE -n END AS length FROM (SELECT conv_id, sum(len({_words('text')}))::BIGINT AS n FROM tn GROUP BY 1))"


def lengths(spark, d) -> DataFrame:
    m = H.ordered(turns(spark, d))
    return m.select(F.col("conv_id").alias("id"), H.signed_length(F.col("messages"), F.when(F.col("conv_id") % 3 == 0, 9).otherwise(0)).cast("long").alias("length"))


@query("modality_lengths", Q.with_(Q.TURNS, LENGTHS) + "SELECT id, length FROM ln")
def modality_lengths(spark, d):
    return lengths(spark, d)


# -- batches and shards ---------------------------------------------------------------------

PLACED = "pl AS MATERIALIZED (SELECT id, abs(length) AS length, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS place FROM ln)"


@query("shuffle_hash", Q.with_(Q.V) + "SELECT id, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS place FROM v")
def shuffle_hash(spark, d):
    return B.shuffled(ids(spark, d), "id")


@query("length_batches", Q.with_(Q.TURNS, LENGTHS, PLACED) + "SELECT id, length, place, place // 8 AS megabatch, row_number() OVER (PARTITION BY place // 8 ORDER BY length DESC, place) - 1 AS rank FROM pl")
def length_batches(spark, d):
    return B.length_batches(lengths(spark, d).select("id", F.abs("length").alias("length")), 8)


BY_SIGN = """sg AS MATERIALIZED (SELECT id, abs(length) AS length, sign(length)::INT AS modality, row_number() OVER (PARTITION BY sign(length) ORDER BY md5('42|' || id), id) - 1 AS place, count(*) OVER (PARTITION BY sign(length)) AS n FROM ln WHERE length <> 0),
mb AS (SELECT *, place // 8 AS m, CASE WHEN n % 8 <> 0 THEN n // 8 ELSE greatest(0, n // 8 - 1) END AS whole, row_number() OVER (PARTITION BY modality, place // 8 ORDER BY length DESC, place) - 1 AS rank FROM sg)"""


@query("modality_batches", Q.with_(Q.TURNS, LENGTHS, BY_SIGN) + "SELECT id, length, modality, CASE WHEN m >= whole THEN 'tail' WHEN modality = 1 THEN 'graph-' || m ELSE 'text-' || m END AS batch, rank FROM mb")
def modality_batches(spark, d):
    return B.modality_batches(lengths(spark, d), 8)


#: Each row of a megabatch in turn, with how long and how full the chunks are by then.
DEALT = """mg AS MATERIALIZED (SELECT id, length, place // 8 AS megabatch, row_number() OVER (PARTITION BY place // 8 ORDER BY length DESC, place) - 1 AS r, count(*) OVER (PARTITION BY place // 8) AS n FROM pl),
dl AS (SELECT megabatch, 0::BIGINT AS r, NULL::BIGINT AS id, NULL::INT AS chunk, NULL::BIGINT AS "at", [0, 0, 0, 0]::BIGINT[] AS load, [0, 0, 0, 0]::BIGINT[] AS held FROM (SELECT DISTINCT megabatch FROM mg)
 UNION ALL SELECT megabatch, r + 1, id, chunk - 1, held[chunk], list_transform(load, lambda x, i: x + CASE WHEN i = chunk THEN length ELSE 0 END), list_transform(held, lambda x, i: x + CASE WHEN i = chunk THEN 1 ELSE 0 END)
 FROM (SELECT d.megabatch, d.r, m.id, m.length, d.load, d.held, CASE WHEN n % 4 <> 0 THEN (m.r % 4 + 1)::INT ELSE list_position(free, list_min(free))::INT END AS chunk
  FROM (SELECT *, list_transform(load, lambda x, i: CASE WHEN held[i] < 2 THEN x ELSE 1000000000 END) AS free FROM dl) d JOIN mg m ON m.megabatch = d.megabatch AND m.r = d.r))"""


@query("balance_chunks", Q.with_(Q.TURNS, LENGTHS, PLACED, DEALT).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT id, megabatch, chunk, \"at\" FROM dl WHERE id IS NOT NULL")
def balance_chunks(spark, d):
    return B.balanced_chunks(length_batches(spark, d), 4)


@query("pad_batch", Q.with_(Q.TURNS, TOKENS, FLAT, "b AS (SELECT conv_id AS id, (row_number() OVER (ORDER BY conv_id) - 1) // 8 AS batch, t[:100] AS t FROM fl)", "m AS (SELECT id, batch, t, max(len(t)) OVER (PARTITION BY batch) AS longest FROM b)") + "SELECT id, batch, longest AS n, len(t) AS attended, md5(array_to_string(list_concat(t, list_transform(range(longest - len(t)), lambda x: '<pad>')), ' ')) AS tokens FROM m")
def pad_batch(spark, d):
    t = flat_tokens(spark, d).select(F.col("conv_id").alias("id"), F.col("t").alias("tokens"))
    p = B.pad_batches(t, 8, 100)
    return p.select("id", "batch", F.size("tokens").alias("n"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("attended"), F.md5(F.array_join("tokens", " ")).alias("tokens"))


@query("block_shard", Q.with_(Q.V, "r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS index FROM v)") + "SELECT id, index, index // (SELECT ceil(count(*) / 7.0)::BIGINT FROM v) AS shard FROM r")
def block_shard(spark, d):
    return B.block_shards(ids(spark, d), 7, "id")


@query("round_robin", Q.with_(Q.V, "r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS index FROM v)") + "SELECT id, index, index % 4 AS shard FROM r")
def round_robin(spark, d):
    return B.round_robin(ids(spark, d), 4, "id")


@query("slice_rows", Q.with_(Q.V, "r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS index FROM v)") + "SELECT id, index FROM r WHERE index >= 10 AND index < 60")
def slice_rows(spark, d):
    return B.row_slice(ids(spark, d), 10, 60, "id")


def _shards(spark, d) -> list[DataFrame]:
    v = T.vectors(spark, d)
    own = [v.where(F.col("id") % 3 == k).select("id", "e", F.lit(k).alias("shard_id"), F.lit(3).alias("num_shards")) for k in range(3)]
    return [own[0], own[1], own[2].where("id % 30 <> 2"), own[0].withColumn("num_shards", F.lit(5))]


@query("shard_merge", Q.with_(Q.V) + f"SELECT id, (id % 3)::INT AS shard_id, {Q.r6('e[1]')} AS first, FALSE AS missing FROM v WHERE id % 30 <> 2 UNION ALL SELECT id, NULL, NULL, TRUE FROM v WHERE id % 30 = 2")
def shard_merge(spark, d):
    every, missing = B.merge_shards(_shards(spark, d), ids(spark, d).count(), 3)
    return every.select("id", "shard_id", rounded(F.col("e")[0]).alias("first"), F.lit(False).alias("missing")).unionByName(missing.select("id", F.lit(None).cast("int").alias("shard_id"), F.lit(None).cast("double").alias("first"), F.lit(True).alias("missing")))


@query("union_shards", Q.with_(Q.V) + "SELECT (id % 3)::INT AS shard, count(*) AS n, sum(id)::BIGINT AS total FROM v GROUP BY 1")
def union_shards(spark, d):
    path = f"{scratch_root(spark)}/loomgraph/shards-{uuid.uuid4().hex}"
    T.write_shards(T.vectors(spark, d).withColumn("shard", (F.col("id") % 3).cast("int")), path)
    return spark.read.parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))


# -- answers --------------------------------------------------------------------------------


def answers(spark: SparkSession, d: str, gt: F.Column, own: F.Column, other: F.Column, whole: F.Column) -> DataFrame:
    """(question_id, gt, text) a part: its own name in some spelling, the next one's, or both."""
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), F.col("p_type").alias("t"))
    nxt = p.select((F.col("k") - 1).alias("k"), F.col("n").alias("n1"), F.col("t").alias("t1"))
    first = p.where("k = 1").first()
    q = p.join(nxt, "k", "left").select("k", "n", "t", F.coalesce("n1", F.lit(first.n)).alias("n2"), F.coalesce("t1", F.lit(first.t)).alias("t2"))
    k = F.col("k")
    text = F.when(k % 7 == 0, F.concat(F.lit("It is "), own, F.lit(" or "), other)).when(k % 3 == 0, F.upper(other)).when(k % 5 == 0, whole).when(k % 2 == 0, F.concat(F.lit("It is a "), F.upper(own), F.lit("."))).otherwise(F.replace(own, F.lit(" "), F.lit("_")))
    return q.select(k.alias("question_id"), gt.alias("gt"), text.alias("text"))



def named(spark, d) -> DataFrame:
    return answers(spark, d, F.col("n"), F.col("n"), F.col("n2"), F.col("n"))


def labels_of(a: DataFrame) -> DataFrame:
    return a.select(F.col("gt").alias("label")).distinct()


FOLD = "trim(regexp_replace(lower(replace({}, '_', ' ')), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'))"


def _said(label: str) -> str:
    a, g = FOLD.format("text"), FOLD.format(label)
    return f"(contains({a}, {g}) OR contains(replace({a}, ' ', ''), replace({g}, ' ', '')))"


@query("nc_generic", Q.with_(Q.answers("n", "n", "n2", "n")) + f"SELECT question_id, {_said('gt')} AS hit, (SELECT count(*) FROM lb WHERE {_said('label')}) AS hits, {_said('gt')} AND (SELECT count(*) FROM lb WHERE {_said('label')}) = 1 AS correct FROM an")
def nc_generic(spark, d):
    return S.generic_classes(named(spark, d))


@query("nc_cora", Q.with_(Q.answers("t || '_goods'", "t", "t2", "t")) + f"SELECT count(*) AS n, {Q.r6('avg((contains(lower(trim(text)), lower(split_part(gt, chr(95), 1))) AND (SELECT count(*) FROM lb WHERE contains(lower(trim(text)), lower(split_part(label, chr(95), 1)))) = 1)::INT)')} AS acc FROM an")
def nc_cora(spark, d):
    a = answers(spark, d, F.concat("t", F.lit("_goods")), F.col("t"), F.col("t2"), F.col("t"))
    return S.first_token_classes(a, labels_of(a))


@query("nc_pubmed", Q.with_(Q.answers("'Customer of land: ' || n", "n", "n2", "'Customer of land: ' || n")) + f"SELECT count(*) AS n, {Q.r6('avg((lower(text) = lower(gt))::INT)')} AS strict_acc, {Q.r6('avg((lower(text) = lower(gt) OR (contains(lower(text), lower(substr(gt, 19))) AND (SELECT count(*) FROM lb WHERE contains(lower(text), lower(substr(label, 19)))) = 1))::INT)')} AS overall_acc FROM an")
def nc_pubmed(spark, d):
    whole = F.concat(F.lit("Customer of land: "), "n")
    a = answers(spark, d, whole, F.col("n"), F.col("n2"), whole)
    return S.suffix_classes(a, labels_of(a))


_CODED = "'p.' || replace(n, ' ', '.') || '(' || n || ')'"


@query(
    "nc_arxiv",
    Q.with_(Q.answers(_CODED, "n", "n2", _CODED), "ac AS (SELECT *, split_part(split_part(gt, '(', 2), ')', 1) AS name, split_part(gt, '(', 1) AS code FROM an), lc AS (SELECT split_part(split_part(label, '(', 2), ')', 1) AS name, split_part(label, '(', 1) AS code FROM lb)")
    + f"SELECT count(*) AS n, {Q.r6('avg((lower(text) = lower(name) OR text = gt)::INT)')} AS strict_acc, {Q.r6('avg((lower(text) = lower(name) OR text = gt OR (contains(lower(text), lower(name)) AND (SELECT count(*) FROM lc WHERE contains(lower(text), lower(lc.name))) = 1) OR (contains(lower(text), lower(code)) AND (SELECT count(*) FROM lc WHERE contains(lower(text), lower(lc.code))) = 1))::INT)')} AS overall_acc FROM ac",
)
def nc_arxiv(spark, d):
    coded = F.concat(F.lit("p."), F.replace(F.col("n"), F.lit(" "), F.lit(".")), F.lit("("), F.col("n"), F.lit(")"))
    a = answers(spark, d, coded, F.col("n"), F.col("n2"), coded)
    return S.coded_classes(a, labels_of(a))


@query("nc_products", Q.with_(Q.answers("n", "n", "n2", "n")) + f"SELECT count(*) AS n, {Q.r6('avg((lower(text) = lower(gt))::INT)')} AS strict_acc, {Q.r6('avg((lower(text) = lower(gt) OR (contains(lower(text), lower(gt)) AND (SELECT count(*) FROM lb WHERE contains(lower(text), lower(label))) <= 2))::INT)')} AS overall_acc FROM an")
def nc_products(spark, d):
    a = named(spark, d)
    return S.tolerant_classes(a, labels_of(a))


@query("nd_accuracy", Q.with_(Q.answers("n", "n", "n2", "n")) + f"SELECT count(*) AS n, {Q.r6('avg(contains(text, substr(gt, 1, 5))::INT)')} AS short_acc, {Q.r6('avg(contains(trim(text), trim(gt))::INT)')} AS all_acc FROM an")
def nd_accuracy(spark, d):
    return S.description_accuracy(named(spark, d))


@query("stop_tokens", Q.with_(Q.TURNS, TOKENS, FLAT) + "SELECT conv_id, md5(array_to_string(t[1:7], ' ')) AS head, least(len(t), 7) AS n FROM fl")
def stop_tokens(spark, d):
    cut = F.when(F.size("t") > 7, F.concat(F.slice("t", 1, 7), F.array(F.lit("</s>")), F.slice("t", 8, 5), F.array(F.lit("<|im_end|>")))).otherwise(F.col("t"))
    t = flat_tokens(spark, d).select("conv_id", H.until_stop(cut).alias("t"))
    return t.select("conv_id", F.md5(F.array_join("t", " ")).alias("head"), F.size("t").alias("n"))


def link_scores(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, gt, score): the graph's edges, and as many hashed pairs as are none."""
    e, v = fixed_edges(spark, d), T.vectors(spark, d)
    pos = e.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    n = v.agg(F.max("id")).first()[0] + 1
    made = pos.select("a", ((F.col("a") * 31 + F.col("b") * 17 + 7) % n).alias("c")).where("a <> c")
    neg = made.join(e, (F.col("a") == F.col("src")) & (F.col("c") == F.col("dst")), "left_anti").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
    both = pos.withColumn("gt", F.lit("yes")).unionByName(neg.withColumn("gt", F.lit("no")))
    x, y = v.select(F.col("id").alias("a"), F.col("e").alias("ea")), v.select(F.col("id").alias("b"), F.col("e").alias("eb"))
    return both.join(x, "a").join(y, "b").select("a", "b", "gt", rounded(cosine(F.col("ea"), F.col("eb"))).alias("score"))


@query("link_scores", Q.with_(*Q.GRAPH, Q.LINKS) + "SELECT a, b, gt, score FROM sc")
def link_scores_query(spark, d):
    return link_scores(spark, d)


@query("lp_accuracy", Q.with_(*Q.GRAPH, Q.LINKS, "x AS (SELECT gt, CASE WHEN score > 0.4 THEN 'yes, they do' ELSE 'No' END AS text FROM sc)") + f"SELECT count(*) AS n, count(*) FILTER (WHERE contains(text, gt) OR (gt = 'no' AND NOT contains(text, 'yes'))) AS correct, {Q.r6('avg((contains(text, gt) OR (gt = ' + lit('no') + ' AND NOT contains(text, ' + lit('yes') + ')))::INT)')} AS acc FROM x")
def lp_accuracy(spark, d):
    said = F.when(F.col("score") > 0.4, "yes, they do").otherwise("No")
    return S.link_accuracy(link_scores(spark, d).select("gt", said.alias("text")))


@query("lp_auc", Q.with_(*Q.GRAPH, Q.LINKS, "rk AS (SELECT gt, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM sc), k AS (SELECT count(*) FILTER (WHERE gt = 'yes') AS p, count(*) FILTER (WHERE gt = 'no') AS m FROM sc)") + f"SELECT p AS n_pos, m AS n_neg, {Q.r6('((SELECT sum(r) FROM rk WHERE gt = ' + lit('yes') + ') - p * (p + 1) / 2.0::DOUBLE) / (p * m)')} AS auc, {Q.r6('(SELECT avg(((score > 0.5) = (gt = ' + lit('yes') + '))::INT) FROM sc)')} AS acc FROM k")
def lp_auc(spark, d):
    return S.ranking(link_scores(spark, d).select("gt", "score"))


@query("lp_hits", Q.with_(*Q.GRAPH, Q.LINKS, "w AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS k FROM sc WHERE gt = 'no')") + f"SELECT k, {Q.r6('avg((s.score > w.score)::INT)')} AS hits FROM w, sc s WHERE k IN (10, 50, 100, 200, 500, 1000) AND s.gt = 'yes' GROUP BY 1")
def lp_hits(spark, d):
    return S.hits_at(link_scores(spark, d).select("gt", "score"))


@query("nd_similarity", Q.with_(Q.V, "pr AS (SELECT a.id, a.e AS t, coalesce(b.e, f.e) AS o FROM v a LEFT JOIN v b ON b.id = a.id + 1 LEFT JOIN v f ON f.id = 0)", "g AS (SELECT sum(list_cosine_similarity(a.t, b.t)) AS s FROM pr a, pr b WHERE a.id <> b.id)") + f"SELECT count(*) AS n, {Q.r6('avg(list_cosine_similarity(t, o))')} AS matched, {Q.r6('(SELECT s FROM g) / (count(*) * (count(*) - 1))')} AS pairwise FROM pr")
def nd_similarity(spark, d):
    v = T.vectors(spark, d)
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("e").alias("n"))
    first = F.array(*(F.lit(float(x)) for x in v.where("id = 0").first().e))
    pairs = v.join(nxt, "id", "left").select(F.col("e").alias("truth"), F.coalesce("n", first).alias("output"))
    return S.description_similarity(pairs, DIM)


@query("dup_ids", "SELECT l_orderkey AS question_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def dup_ids(spark, d):
    return S.repeated_ids(T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id")))


@query("majority_vote", "WITH c AS (SELECT l_orderkey AS id, l_returnflag AS vote, count(*) AS n, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2) SELECT id, vote AS winner FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, f, vote DESC) AS q FROM c) WHERE q = 1")
def majority_vote(spark, d):
    return S.majority(T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("vote")))


@query("resume_antijoin", Q.with_(Q.answers("n", "n", "n2", "n")) + "SELECT question_id, text FROM an WHERE question_id % 4 <> 1")
def resume_antijoin(spark, d):
    a = named(spark, d)
    return B.not_yet_written(a, a.where("question_id % 4 = 1")).select("question_id", "text")


@query("answers_sink", Q.with_(Q.answers("n", "n", "n2", "n")) + "SELECT question_id, text, gt FROM an")
def answers_sink(spark, d):
    """Two runs over the same answers, the first cut off: each question is there once."""
    a = stash(named(spark, d), "answers")
    path = f"{scratch_root(spark)}/loomgraph/answers-{uuid.uuid4().hex}"
    T.append_answers(a.where("question_id % 4 = 1"), path)
    T.append_answers(a, path)
    return T.read_answers(spark, path).select("question_id", "text", "gt")
