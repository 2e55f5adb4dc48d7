"""SQL for those queries of this folder that SQL can express.

The others have no such statement: sharding edits a map step by step, token counts and
fingerprints and SimHash need hashes and merges that SQL lacks, packing, alignment and the last
bin of a mix are sequential, toxicity is a model, and the expressions of personal data look behind
themselves. They are tested against plain versions of their rules.
"""

from ..plans.sql import CRC, crc32
from . import codebooks, resampling
from .common import LOWER, UPPER, WORD
from .licenses import BASE, LEAST_SHARE, NOTICES

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"

OP6 = f"""WITH dw AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
bw AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (SELECT item_id, array_to_string(w[i + 1 : i + 10], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0)),
lens AS MATERIALIZED (SELECT DISTINCT n FROM win),
dwin AS MATERIALIZED (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT d.doc_id, d.i, d.n, w.item_id FROM dwin d JOIN win w ON w.win = d.win AND w.n = d.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
itm AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN itm USING (doc_id)"""


def _templates() -> str:
    rows = [(label, phrase.split(), 0, len(phrase.split()), True) for phrase, label in BASE.items()]
    for label, text, key in NOTICES:
        words, k = text.split(), key.split()
        rows.append((label, words, next(i for i in range(len(words)) if words[i : i + len(k)] == k), len(k), False))
    return ", ".join(f"({i}, '{label}', {words}, {at}, {n}, {base})" for i, (label, words, at, n, base) in enumerate(rows))


OP9 = f"""WITH dw AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
tpl(id, label, words, key_at, key_n, base) AS MATERIALIZED (VALUES {_templates()}),
keys AS MATERIALIZED (SELECT *, array_to_string(words[key_at + 1 : key_at + key_n], ' ') AS phrase FROM tpl),
lens AS MATERIALIZED (SELECT DISTINCT key_n AS n FROM tpl),
win AS MATERIALIZED (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT doc_id, id, label, words, base, i - key_at AS start FROM win JOIN keys ON win = phrase AND n = key_n),
spot AS (SELECT *, unnest(range(len(words))) AS j FROM hit),
fit AS MATERIALIZED (SELECT doc_id, id, label, base, start, avg((start + j >= 0 AND start + j < len(w) AND coalesce(w[greatest(start + j, 0) + 1] = words[j + 1], FALSE))::INT) AS share
  FROM spot JOIN dw USING (doc_id) GROUP BY ALL HAVING share >= {LEAST_SHARE}),
per AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM fit GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM dw LEFT JOIN per USING (doc_id)"""


def _lloyd() -> str:
    """Every round anew over all rows. Vectors of one length are taken for granted, and sums below 2 ** 53."""
    parts, limit = codebooks.PARTS, codebooks.LIMIT
    out = [
        f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid, vec_id, label, v FROM (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(greatest(-{limit}, least({limit}, {codebooks.SCALE} * x)))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))",
        f"cut AS MATERIALIZED (SELECT rid, p, v[p * w + 1 : (p + 1) * w] AS a FROM (SELECT *, len(v) // {parts} AS w FROM v), range({parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, rid - 1 AS k, a AS b FROM cut WHERE rid <= {codebooks.ENTRIES})",
    ]
    for r in range(codebooks.ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT rid, p, m.d AS d, m.k AS k FROM (SELECT rid, p, min({{'d': list_inner_product(a, a) - 2 * list_inner_product(a, b) + list_inner_product(b, b), 'k': k}}) AS m FROM cut JOIN c{r} USING (p) GROUP BY 1, 2))")
        if r < codebooks.ROUNDS:
            out += [
                f"m{r} AS MATERIALIZED (SELECT p, k, list(x ORDER BY pos) AS b FROM (SELECT p, k, pos, floor(sum(x) / count(*)) AS x FROM (SELECT p, k, unnest(a) AS x, generate_subscripts(a, 1) AS pos FROM cut JOIN a{r} USING (rid, p)) GROUP BY 1, 2, 3) GROUP BY 1, 2)",
                f"c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{r}.b, c{r}.b) AS b FROM c{r} LEFT JOIN m{r} USING (p, k))",
            ]
    last = codebooks.ROUNDS
    out += [
        f"sha AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, k, pos)) AS codebooks_sha256 FROM (SELECT p, k, unnest(b) AS x, generate_subscripts(b, 1) AS pos FROM c{last}))",
        f"per AS MATERIALIZED (SELECT rid, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY 1)",
    ]
    return "WITH " + ",\n".join(out) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM per JOIN v USING (rid), sha"


def _resampled() -> str:
    n = resampling.N_BUCKETS
    runs = lambda t: f"SELECT rid, unnest(w) AS f FROM {t} UNION ALL SELECT rid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {t}"
    counted = lambda t: f"SELECT bucket, count(*) AS n FROM {t} JOIN fb USING (f) GROUP BY 1"
    ctes = [
        CRC,
        f"dw AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents)",
        f"bw AS MATERIALIZED (SELECT 0 AS rid, {_WORDS} AS w FROM benchmark)",
        f"df AS MATERIALIZED ({runs('dw')})",
        f"bf AS MATERIALIZED ({runs('bw')})",
        f"fb AS MATERIALIZED (SELECT f, {crc32('f')} % {n} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), ct)",
        f"gn AS MATERIALIZED (SELECT r.i AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {n}) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + {n}))))::BIGINT AS gain FROM range({n}) r(i) LEFT JOIN ({counted('df')}) s ON s.bucket = i LEFT JOIN ({counted('bf')}) t ON t.bucket = i)",
        "wt AS MATERIALIZED (SELECT rid, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN fb USING (f) JOIN gn USING (bucket) GROUP BY 1)",
        f"sc AS MATERIALIZED (SELECT rid, doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM dw LEFT JOIN wt USING (rid))",
        f"rk AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS r, count(*) OVER () * {resampling.DRAWN_PERCENT} // 100 AS drawn FROM sc WHERE words >= {resampling.LEAST_WORDS})",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN r <= drawn THEN r END AS rank FROM sc LEFT JOIN rk USING (rid)"


ORACLES: dict[str, str] = {"op12_codebooks": _lloyd(), "op13_resampling": _resampled(), "op6_decontamination": OP6, "op9_licenses": OP9}
