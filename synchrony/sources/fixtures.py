"""Deterministic views that give the driver's tables the shapes of recordings, in Spark SQL and in DuckDB.

``FIXTURES.md`` describes them. A view is plain SQL over tables and other views; the few differences between the
engines stand in ``ENGINE``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")

#: Placeholders: G (replace all), UNNEST(n) over 0..n, hints for Spark (both sides grow; see ``shared.large``), and splitting of a text into words with positions.
ENGINE = {
    "spark": {"{G}": "", "{MERGE:f,u}": "/*+ MERGE(f, u) */ ", "{MERGE:s,k}": "/*+ MERGE(s, k) */ ", "{SERIES}": "explode(sequence(0, {n}))", "{WORDS}": "SELECT conv_id, turn, pos, word FROM conversations LATERAL VIEW posexplode(split(text, ' ')) AS pos, word"},
    "duckdb": {
        "{G}": ", 'g'",
        "{MERGE:f,u}": "",
        "{MERGE:s,k}": "",
        "{SERIES}": "unnest(generate_series(0, {n}))",
        "{WORDS}": "SELECT conv_id, turn, generate_subscripts(string_split(text, ' '), 1) AS pos, unnest(string_split(text, ' ')) AS word FROM conversations",
    },
}

VIEWS = {
    "fx_align": """WITH b AS (SELECT l_suppkey % 24 AS vn, (l_orderkey*10 + l_linenumber)*1000000 + l_partkey AS keyword_id, l_orderkey % 40 AS segment_id,
  (l_orderkey % 6000)/10.0e0 AS t_narr, l_partkey % 20 AS c, l_quantity AS q, l_tax AS x, l_returnflag AS rf, l_linenumber AS ln FROM lineitem),
d AS (SELECT *, CASE WHEN c<4 THEN 'A' WHEN c<7 THEN 'D' WHEN c<8 THEN 'B' WHEN c<9 THEN 'C' WHEN c<10 THEN 'E' WHEN c<11 THEN 'G' ELSE 'F' END AS match_case FROM b),
e AS (SELECT *, CASE WHEN match_case IN ('A','D') THEN (1-q)/1.5e0 WHEN match_case='B' THEN q/8.0e0 WHEN match_case='C' THEN 10.0e0
  WHEN match_case IN ('E','G') THEN (q-25)/5.0e0 END AS delta_t FROM d)
SELECT concat('v', CAST(vn AS VARCHAR(4))) AS video_id, keyword_id, segment_id, t_narr, t_narr+delta_t AS t_vis, delta_t, match_case,
  CASE WHEN match_case='F' THEN 0.0e0 WHEN match_case='C' THEN 0.8e0 WHEN match_case='E' THEN 0.6e0+x WHEN match_case='G' THEN 0.25e0 WHEN rf='N' THEN 1.0e0 ELSE 0.8e0 END AS alpha,
  CASE WHEN match_case<>'F' THEN t_narr+delta_t END AS scene_t_start, CASE WHEN match_case<>'F' THEN t_narr+delta_t+2+x*100 END AS scene_t_end,
  CASE WHEN match_case='F' AND ln % 3 = 0 THEN 'LOW' WHEN ln % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS groundability,
  CASE WHEN match_case='F' THEN CASE ln % 4 WHEN 0 THEN 'no_t_narr' WHEN 1 THEN 'no_ocr_nearby' WHEN 2 THEN 'ocr_vocabulary_mismatch' ELSE 'low_groundability' END ELSE lower(match_case) END AS match_method FROM e""",
    "fx_importance": """SELECT DISTINCT video_id, segment_id, CAST(1 + (segment_id*7) % 5 AS INT) AS importance,
  CASE WHEN CAST(substring(video_id, 2) AS INT) % 2 = 0 THEN 'heuristic' ELSE 'llm' END AS backend FROM fx_align WHERE segment_id % 13 <> 0""",
    "fx_words": """WITH w AS ({WORDS}), i AS (SELECT conv_id, word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos)-1 AS word_id FROM w WHERE word<>''),
j AS (SELECT conv_id, word, word_id, word_id*0.4e0 + 4.0e0*floor(word_id/60) AS s FROM i)
SELECT concat('c', CAST(conv_id AS VARCHAR(9))) AS video_id, conv_id, CAST(word_id AS BIGINT) AS word_id, word,
 CASE WHEN word_id % 101 = 50 THEN NULL ELSE s END AS start_time,
 CASE WHEN word_id % 101 = 50 THEN NULL WHEN word_id % 37 = 5 THEN s+2.5e0 WHEN word_id % 53 = 7 THEN s+0.02e0 ELSE s+0.3e0 END AS end_time FROM j""",
    "fx_segments": """SELECT video_id, CAST(floor(word_id/12) AS BIGINT) AS segment_id, {JOIN_WORDS} AS text, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS n_words
 FROM fx_words GROUP BY video_id, CAST(floor(word_id/12) AS BIGINT)""",
    "fx_scenes": """WITH m AS (SELECT video_id, max(start_time) AS t_max FROM fx_words GROUP BY video_id),
k AS (SELECT video_id, t_max, CAST(floor(t_max/8) AS INT) AS n FROM m)
SELECT video_id, scene_id, 8.0e0*scene_id AS t_start, least(8.0e0*scene_id+8, t_max) AS t_end, 8.0e0*scene_id + least(4.0e0, (t_max-8.0e0*scene_id)/2) AS t_keyframe
FROM (SELECT video_id, t_max, {SERIES:n} AS scene_id FROM k) g""",
    "fx_ocr": """WITH t AS (SELECT video_id, conv_id, word_id, lower(regexp_replace(word,'[^A-Za-z0-9]',''{G})) AS tok, start_time, (conv_id % 4)*3-3 AS lag_s FROM fx_words WHERE start_time IS NOT NULL),
u AS (SELECT video_id, tok, word_id, CAST(floor(greatest(start_time+lag_s,0)/8) AS INT) AS blk FROM t WHERE length(tok)>=4),
x AS (SELECT video_id, CAST(floor(max(start_time)*2) AS INT) AS n FROM fx_words GROUP BY video_id), f AS (SELECT video_id, i*0.5e0 AS frame_time FROM (SELECT video_id, {SERIES:n} AS i FROM x) y)
SELECT {MERGE:f,u}DISTINCT f.video_id, f.frame_time, u.tok FROM f JOIN u ON u.video_id=f.video_id AND u.blk=CAST(floor(f.frame_time/8) AS INT)
 AND (u.word_id % 3 <> 0 OR f.frame_time - 8*u.blk >= 4)""",
    "fx_keywords": """WITH t AS (SELECT video_id, word_id, start_time, lower(regexp_replace(word,'[^A-Za-z0-9]',''{G})) AS tok FROM fx_words WHERE start_time IS NOT NULL)
SELECT video_id, word_id AS keyword_id, CAST(floor(word_id/12) AS BIGINT) AS segment_id, tok AS keyword_text, start_time AS t_narr FROM t WHERE length(tok)>=4 AND word_id % 6 = 0""",
    # keywords of two neighbouring words
    "fx_phrases": """WITH t AS (SELECT video_id, word_id, start_time, lower(regexp_replace(word,'[^A-Za-z0-9]',''{G})) AS tok, lower(regexp_replace(lead(word) OVER (PARTITION BY video_id ORDER BY word_id),'[^A-Za-z0-9]',''{G})) AS tok2 FROM fx_words)
SELECT video_id, word_id AS keyword_id, CAST(floor(word_id/12) AS BIGINT) AS segment_id, concat(tok, ' ', tok2) AS keyword_text, start_time AS t_narr FROM t WHERE start_time IS NOT NULL AND length(tok)>=2 AND length(tok2)>=2 AND word_id % 6 = 3""",
    "fx_phrase_concepts": """SELECT {MERGE:s,k}s.video_id, s.scene_id, s.t_start, s.t_end, s.t_keyframe, k.keyword_text AS concept FROM fx_scenes s JOIN fx_phrases k ON k.video_id = s.video_id AND k.t_narr >= s.t_start AND k.t_narr < s.t_end AND k.keyword_id % 4 < 2""",
    "fx_frames": """SELECT concat('e', CAST(label AS VARCHAR(9))) AS video_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS INT) AS frame_idx,
 (row_number() OVER (PARTITION BY label ORDER BY vec_id)-1)*0.5e0 AS frame_time, vec_id, embedding FROM embeddings""",
    "fx_series": """SELECT concat('u', CAST(user_id AS VARCHAR(9))) AS video_id, CAST(i AS INT) AS frame_idx, i*0.5e0 AS t, value/100.0e0 AS mad, 1/(1+value/2000.0e0) AS ssim
 FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS i FROM events) x""",
    "fx_tiers": """WITH b AS (SELECT o_custkey % 12 AS vn, o_orderkey % 50 AS segment_id, min(o_orderkey) AS k, count(*) AS n FROM orders GROUP BY 1,2),
 t AS (SELECT 't1' AS tier UNION ALL SELECT 't2' UNION ALL SELECT 't3')
 SELECT concat('v',CAST(vn AS VARCHAR(4))) AS video_id, segment_id, tier, 1 + CASE tier WHEN 't1' THEN k WHEN 't2' THEN k + n ELSE segment_id + vn END % 5 AS importance FROM b CROSS JOIN t""",
    # Every event is a rating (a rater's further ratings of eight events in a row are of sibling items), every recording a variant.
    "fx_ratings": """SELECT concat('i', CAST(CAST(floor(event_id/8) AS BIGINT)*13 + rn - 1 AS VARCHAR(20))) AS item, concat('r', CAST(user_id AS VARCHAR(20))) AS rater, 1+CAST(floor(value) AS BIGINT) % 5 AS rating, ts
 FROM (SELECT *, row_number() OVER (PARTITION BY CAST(floor(event_id/8) AS BIGINT), user_id ORDER BY ts, event_id) AS rn FROM events) x""",
    "fx_panel": """SELECT concat('i', CAST(CAST(floor(event_id/5) AS BIGINT) AS VARCHAR(20))) AS item, concat('r', CAST(event_id % 5 AS VARCHAR(9))) AS rater, 1+CAST(floor(value) AS BIGINT) % 5 AS rating, ts FROM events""",
    "fx_variants": """SELECT video_id, concat('S',CAST(CAST(floor(n/4) AS INT) AS VARCHAR(3))) AS set_name, CAST(CASE n % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 5 END AS INT) AS delay_level
 FROM (SELECT DISTINCT video_id, CAST(substring(video_id,2) AS INT) AS n FROM fx_align) x""",
    "fx_llm": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text ELSE concat(text, ' Sure: [{"segment_id": ', CAST(doc_id AS VARCHAR(20)), ', "importance": ', CAST(doc_id % 9 AS VARCHAR(9)), ', "reason": "r"}] done ', text) END AS response FROM documents""",
    "fx_concepts": """SELECT {MERGE:s,k}s.video_id, s.scene_id, s.t_start, s.t_end, s.t_keyframe, k.keyword_text AS concept FROM fx_scenes s JOIN fx_keywords k ON k.video_id = s.video_id AND k.t_narr >= s.t_start AND k.t_narr < s.t_end""",
}


def expand(sql: str, engine: str) -> str:
    for k, v in ENGINE[engine].items():
        if k == "{SERIES}":
            sql = re.sub(r"\{SERIES:(\w+)\}", lambda m: v.replace("{n}", m[1]), sql)
        else:
            sql = sql.replace(k, v)
    join = "array_join(transform(sort_array(collect_list(struct(word_id, word))), x -> x.word), ' ')" if engine == "spark" else "string_agg(word, ' ' ORDER BY word_id)"
    return sql.replace("{JOIN_WORDS}", join)


def with_views(sql: str, engine: str = "duckdb") -> str:
    """SQL with the views that it names put in front of it."""
    found: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEWS and name not in found:
                need(VIEWS[name])
                if name not in found:
                    found.append(name)

    need(sql)
    head = ", ".join(f"{n} AS ({expand(VIEWS[n], engine)})" for n in found)
    if not head:
        return sql
    body = sql.lstrip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


def over(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A fixture view over given tables, which may be streams."""
    sql = with_views(f"SELECT * FROM {name}", "spark").replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **tables)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables in a folder."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", with_views(f"SELECT * FROM {name}", "spark"))]
    return over(spark, name, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
