"""Registered queries of the training-data operators: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _arrow(spark: SparkSession) -> None:
    """Rows per Arrow batch such that a batch of very long texts still fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over all documents: bins of 2,048 words."""
    from stockflow.llm.packing import pack_documents
    _arrow(spark)
    return pack_documents(_read(spark, sf_dir, "documents"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over all pages: written as WARC, indexed, looked up and read back."""
    from stockflow.llm.warc import archive_round_trip
    _arrow(spark)
    return archive_round_trip(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over all documents."""
    from stockflow.llm.licenses import license_report
    _arrow(spark)
    return license_report(_read(spark, sf_dir, "documents"))


def op4_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over all documents: what the mix takes of each."""
    from stockflow.llm.mixing import mixture
    return mixture(_read(spark, sf_dir, "documents"))


def op5_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over all documents, fitted on labels outside fold 0."""
    from stockflow.llm.toxicity import toxicity_scores
    _arrow(spark)
    return toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all documents and their edited texts."""
    from stockflow.llm.fingerprint import edited_fingerprints
    return edited_fingerprints(_read(spark, sf_dir, "documents"))


def op7_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over all documents: fingerprint and component of each row."""
    from stockflow.llm.simhash import simhash_components
    _arrow(spark)
    return simhash_components(_read(spark, sf_dir, "documents"))


def op8_vptree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: ten nearest vectors of every hundredth vec_id among all embeddings."""
    from stockflow.llm.ann import nearest
    _arrow(spark)
    return nearest(_read(spark, sf_dir, "embeddings"))


def op9_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over all documents, fitted on labels outside fold 0."""
    from stockflow.llm.quality import quality_scores
    _arrow(spark)
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all conversations and conversation -1, read back from its output."""
    from stockflow.llm.chat import conversation_digests, format_conversations, probe_conversation
    _arrow(spark)
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(format_conversations(turns.unionByName(probe_conversation(turns))))


#: Operator 11's rules (action, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Whose urls are listed: captures from hosts of these names, and captures that hold an insult.
LISTED_HOSTS = "(^|[.])(spam-farm|cheap-pills|casino-win|adult-x|free-bets|ads-track)[.]"
LISTED_HTML = "(?i)(worthless|idiot|stupid|moron|pathetic)"


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over all pages: five rules, then the list of reported captures' urls."""
    from stockflow.llm.urls import Rule, judge_urls, url_host
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    listed = pages.filter(url_host(F.col("url")).rlike(LISTED_HOSTS) | F.col("html").rlike(LISTED_HTML)).select("url")
    return judge_urls(pages, [Rule(*r) for r in URL_RULES], listed)


def _url_sql() -> str:
    from stockflow.llm.urls import TRACKING
    fits = [f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN "
            for _, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))]
    order = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"{f}'{h}{p}'" for f, (_, h, p) in zip(fits, order))
    action = " ".join(f"{f}'{a}'" for f, (a, _, _) in zip(fits, order))
    return f"""
WITH cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
                 list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'),
                                       lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))) AS kept FROM cut),
named AS (SELECT *, CASE WHEN rest IS NOT NULL THEN
             regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':(80|443)?$', ''), '[.]+$', ''), '^www[.]', '')
             || regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/index[.](html?|php)$', '/'), '/$', '')
             || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM named WHERE canonical IS NOT NULL
           AND (regexp_matches(host, '{LISTED_HOSTS}') OR regexp_matches(html, '{LISTED_HTML}'))),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {action} END AS action,
                 coalesce(canonical IN (SELECT canonical FROM listed), false) AS found FROM named)
SELECT page_id, host, path, rule, canonical, CASE WHEN rule IS NULL THEN found END AS listed,
       coalesce(action, CASE WHEN found THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over all conversations, rebuilt by hundreds."""
    from stockflow.llm.trie import conversation_trie
    _arrow(spark)
    return conversation_trie(_read(spark, sf_dir, "conversations")).drop("node")


TRIE_SQL = """
WITH own AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT c, ts, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
              lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))),
              4294967295) % 6 AS h FROM own),
rebuilt AS (SELECT o.c, coalesce(b.ts[1:o.h], []) || o.ts[o.h + 1:] AS s FROM heads o LEFT JOIN own b ON b.c = o.c - o.c % 100),
walk AS (SELECT c, s, len(s) AS n, unnest(range(0, len(s) + 1)) AS d FROM rebuilt),
at_ AS (SELECT c, n, d, sha256(to_json(s[1:d])::VARCHAR) AS node, coalesce(length(s[d].t), 0) AS chars FROM walk),
nodes AS (SELECT node, d, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * min(chars) AS spared FROM at_ GROUP BY node, d),
links AS (SELECT DISTINCT a.node AS parent, b.node FROM at_ a JOIN at_ b ON a.c = b.c AND b.d = a.d + 1),
kids AS (SELECT parent, count(*) AS k FROM links GROUP BY parent),
under AS (SELECT DISTINCT a.node AS top, b.node FROM at_ a JOIN at_ b ON a.c = b.c AND b.d >= a.d),
sub AS (SELECT top, sum(spared)::BIGINT AS saved, count(*) FILTER (kids.k IS NULL) AS leaves
        FROM under JOIN nodes USING (node) LEFT JOIN kids ON kids.parent = under.node GROUP BY top),
ends AS (SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM at_ WHERE d = n GROUP BY node)
SELECT nodes.c AS conv_id, nodes.d AS depth, p.c AS parent_conv_id, nodes.n_convs, coalesce(kids.k, 0) AS n_children,
       sub.leaves AS n_leaves, sub.saved AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM nodes JOIN sub ON sub.top = nodes.node LEFT JOIN kids ON kids.parent = nodes.node LEFT JOIN ends ON ends.node = nodes.node
LEFT JOIN links ON links.node = nodes.node LEFT JOIN nodes p ON p.node = links.parent"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over all documents: the best 2,000 phrases of two or three words of each language."""
    from stockflow.llm.collocations import collocations
    _arrow(spark)
    return collocations(_read(spark, sf_dir, "documents").select("lang", "text"))


COLLOCATION_SQL = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, m AS size, unnest(list_transform(generate_series(1, len(w) - m + 1),
                 lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
          FROM words, (VALUES (1), (2), (3)) sizes(m) WHERE len(w) >= m),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, size, phrase, a, w, unnest(generate_series(1, size - 1)) AS k FROM cand),
scores AS (SELECT c.lang, c.size, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
                  ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
                       JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')),
low AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, max(a) AS outer_a
           FROM cand, (VALUES (1), (2)) starts(s) WHERE size = 3 GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inner_ i ON i.lang = low.lang AND i.phrase = low.phrase AND low.size = 2
         WHERE i.outer_a IS NULL OR 100 * i.outer_a < 50 * low.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank,
       phrase, a, l, r, n, score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over all documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_best_fit_packing": (op1_best_fit_packing, None),
    "op2_warc_index": (op2_warc_index, None),
    "op3_license_index": (op3_license_index, None),
    "op4_pareto_mixing": (op4_pareto_mixing, None),
    "op5_weak_toxicity": (op5_weak_toxicity, None),
    "op6_minhash_fingerprints": (op6_minhash_fingerprints, None),
    "op7_simhash_vptree": (op7_simhash_vptree, None),
    "op10_chat_tokens": (op10_chat_tokens, None),
    "pipeline": (pipeline, None),
    "op8_vptree_neighbours": (op8_vptree_neighbours, None),
    "op9_byte_convnet": (op9_byte_convnet, None),
    "op11_url_filter": (op11_url_filter, _url_sql()),
    "op12_prefix_trie": (op12_prefix_trie, TRIE_SQL),
    "op13_collocations": (op13_collocations, COLLOCATION_SQL),
}
