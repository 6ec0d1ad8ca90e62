"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from creasework.llm import fim, runs
from creasework.llm.decontaminate import op1_decontaminate
from creasework.llm.fim import op12_fim
from creasework.llm.html import op3_html
from creasework.llm.language import op5_language
from creasework.llm.licences import op10_licences
from creasework.llm.packing import op4_pack
from creasework.llm.runs import op11_runs
from creasework.llm.sharding import op9_shards
from creasework.llm.simhash import op7_simhash
from creasework.llm.sketches import op2_fingerprints
from creasework.llm.tokens import op13_token_files
from creasework.llm.toxicity import op6_toxicity
from creasework.llm.warc import op8_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_fingerprints": op2_fingerprints,
    "op3_html": op3_html,
    "op4_pack": op4_pack,
    "op5_language": op5_language,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_shards": op9_shards,
    "op10_licences": op10_licences,
    "op11_runs": op11_runs,
    "op12_fim": op12_fim,
    "op13_token_files": op13_token_files,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op1_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + 9] AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
t AS (SELECT doc_id, i, n, w[i:i + n - 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM g) WHERE i + n - 1 <= len(w)),
h AS (SELECT doc_id, i, t.n, item_id FROM t JOIN g USING (n, gram)),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op11_runs": runs.SQL,
    "op12_fim": fim.SQL,
}
