"""Queries on alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as A
from ..sources.shared import large, settled
from . import sqltext
from .registry import register

KW = "(SELECT *, 'HIGH' AS groundability FROM fx_keywords WHERE keyword_id % 5 <> 0 UNION ALL SELECT *, 'LOW' AS groundability FROM fx_keywords WHERE keyword_id % 5 = 0)"


def keywords(s, view="fx_keywords"):
    return s(view).withColumn("groundability", F.when(F.col("keyword_id") % 5 == 0, "LOW").otherwise("HIGH"))


def able(s, view="fx_keywords"):
    return keywords(s, view).where("groundability <> 'LOW'")


def tables(s, view="fx_keywords"):
    """The tables of the cascade, derived once: its cases read them many times."""
    return [settled(df, "cascade") for df in (keywords(s, view), A.shown(s("fx_ocr")), s("fx_scenes"))]


def parts(s, view="fx_keywords", threshold=None):
    """Keywords, shown tokens, scenes and token hits, each written once: a case reads them several times."""
    k, ocr, scenes = (settled(df, "cascade") for df in (able(s, view), A.shown(s("fx_ocr")), s("fx_scenes")))
    return k, ocr, scenes, settled(A.token_hits(k, ocr, threshold), "token-hits")


#: One-word keywords and exact tokens: the cases in SQL.
BASE = f"""WITH k AS (SELECT * FROM {KW} x WHERE groundability <> 'LOW'), sc AS (SELECT * FROM fx_scenes),
cur AS (SELECT video_id, keyword_id, keyword_text, t_narr, scene_id, t_start, t_end FROM (SELECT k.*, s.scene_id, s.t_start, s.t_end, row_number() OVER (PARTITION BY k.video_id, k.keyword_id ORDER BY CASE WHEN k.t_narr BETWEEN s.t_start AND s.t_end THEN 0 ELSE 1 END, CASE WHEN k.t_narr BETWEEN s.t_start AND s.t_end THEN 0 ELSE abs((s.t_start+s.t_end)/2-k.t_narr) END, s.scene_id) AS rn FROM k JOIN sc s USING (video_id)) WHERE rn = 1),
a AS (SELECT cur.video_id, cur.keyword_id, cur.t_narr, min(o.frame_time) AS t_vis, cur.scene_id, cur.t_start, cur.t_end FROM cur JOIN fx_ocr o ON o.video_id=cur.video_id AND o.tok=cur.keyword_text AND o.frame_time BETWEEN cur.t_start AND cur.t_end GROUP BY ALL),
bf AS (SELECT k.video_id, k.keyword_id, k.keyword_text, k.t_narr, min(o.frame_time) AS seen FROM k JOIN fx_ocr o ON o.video_id=k.video_id AND o.tok=k.keyword_text AND o.frame_time BETWEEN k.t_narr+1 AND k.t_narr+10 GROUP BY ALL),
bs AS (SELECT * FROM (SELECT bf.*, s.scene_id, s.t_start, s.t_end, row_number() OVER (PARTITION BY bf.video_id, bf.keyword_id ORDER BY CASE WHEN seen BETWEEN s.t_start AND s.t_end THEN 0 ELSE 1 END, CASE WHEN seen BETWEEN s.t_start AND s.t_end THEN 0 ELSE abs((s.t_start+s.t_end)/2-seen) END, s.scene_id) AS rn FROM bf JOIN sc s USING (video_id)) WHERE rn = 1),
fr AS (SELECT DISTINCT video_id, frame_time FROM fx_ocr),
bn AS (SELECT * FROM (SELECT bs.*, f.frame_time AS sf, row_number() OVER (PARTITION BY bs.video_id, bs.keyword_id ORDER BY abs(f.frame_time-bs.t_start), f.frame_time) AS r2 FROM bs LEFT JOIN fr f ON f.video_id=bs.video_id AND f.frame_time BETWEEN bs.t_start-1 AND bs.t_start+1) WHERE r2 = 1),
b AS (SELECT bn.video_id, bn.keyword_id, bn.t_narr, CASE WHEN EXISTS (SELECT 1 FROM fx_ocr o WHERE o.video_id=bn.video_id AND o.frame_time=bn.sf AND o.tok=bn.keyword_text) THEN t_start ELSE seen END AS t_vis, scene_id, t_start, t_end FROM bn),
cf AS (SELECT k.video_id, k.keyword_id, k.t_narr, max(o.frame_time) AS seen FROM k JOIN fx_ocr o ON o.video_id=k.video_id AND o.tok=k.keyword_text AND o.frame_time >= k.t_narr-10 AND o.frame_time < k.t_narr-1 GROUP BY ALL),
c AS (SELECT video_id, keyword_id, t_narr, t_start AS t_vis, scene_id, t_start, t_end FROM (SELECT cf.*, s.scene_id, s.t_start, s.t_end, row_number() OVER (PARTITION BY cf.video_id, cf.keyword_id ORDER BY CASE WHEN seen BETWEEN s.t_start AND s.t_end THEN 0 ELSE 1 END, CASE WHEN seen BETWEEN s.t_start AND s.t_end THEN 0 ELSE abs((s.t_start+s.t_end)/2-seen) END, s.scene_id) AS rn FROM cf JOIN sc s USING (video_id)) WHERE rn = 1 AND t_end < t_narr),
e AS (SELECT video_id, keyword_id, t_narr, arg_min(t_start, scene_id) AS t_vis, min(scene_id) AS scene_id, arg_min(t_start, scene_id) AS t_start, arg_min(t_end, scene_id) AS t_end FROM (SELECT k.video_id, k.keyword_id, k.t_narr, x.scene_id, x.t_start, x.t_end FROM k JOIN fx_concepts x ON x.video_id=k.video_id AND x.t_keyframe BETWEEN k.t_narr-10 AND k.t_narr+10 AND (contains(x.concept, k.keyword_text) OR contains(k.keyword_text, x.concept))) GROUP BY 1, 2, 3) """
COLS = ["video_id", "keyword_id", "t_vis", "delta_t", "match_case", "alpha", "scene_id"]


def case_sql(t: str, case: str, alpha: str, delta: str = "t_vis - t_narr") -> str:
    return f"SELECT video_id, keyword_id, t_vis, {delta} AS delta_t, {case} AS match_case, {alpha} AS alpha, scene_id FROM {t}"


AD = case_sql("a", "CASE WHEN t_vis <= t_start + 1 THEN 'A' ELSE 'D' END", "1e0")
register("a1_case_a_d", BASE + AD, "t_vis delta_t alpha")(lambda s: A.case_a_d(*parts(s)).select(*COLS))
register("a2_case_b_forward", BASE + case_sql("b", "'B'", "1e0"), "t_vis delta_t alpha")(lambda s: A.case_b_forward(*parts(s)).select(*COLS))
register("a3_case_c_backward", BASE + case_sql("c", "'C'", "0.8e0", "10e0"), "t_vis delta_t alpha")(lambda s: A.case_c_backward(*parts(s)).select(*COLS))
register("a4_case_e_concept", BASE + case_sql("e", "'E'", "0.9e0"), "t_vis delta_t alpha")(lambda s: A.case_e_concept(able(s), s("fx_concepts"), exact_only=True).select(*COLS))
register(
    "a6_no_match_reason",
    f"SELECT k.video_id, k.keyword_id, CASE WHEN groundability='LOW' THEN 'low_groundability' WHEN t_narr IS NULL THEN 'no_t_narr' WHEN NOT EXISTS (SELECT 1 FROM fx_ocr o WHERE o.video_id=k.video_id AND o.frame_time BETWEEN k.t_narr-10 AND k.t_narr+10) THEN 'no_ocr_nearby' ELSE 'ocr_vocabulary_mismatch' END AS match_method FROM {KW} k",
)(lambda s: A.no_match_reason(keywords(s), s("fx_ocr")).select("video_id", "keyword_id", "match_method"))
register(
    "a7_cascade",
    BASE
    + f", u AS (SELECT *, 0 AS r FROM ({AD}) UNION ALL SELECT *, 1 FROM ({case_sql('b', chr(39) + 'B' + chr(39), '1e0')}) UNION ALL SELECT *, 2 FROM ({case_sql('c', chr(39) + 'C' + chr(39), '0.8e0', '10e0')}) UNION ALL SELECT *, 3 FROM ({case_sql('e', chr(39) + 'E' + chr(39), '0.9e0')}) UNION ALL SELECT video_id, keyword_id, NULL, NULL, 'F', 0e0, NULL, 9 FROM {KW} z), q AS (SELECT *, row_number() OVER (PARTITION BY video_id, keyword_id ORDER BY r) AS rn FROM u) SELECT {', '.join(COLS)} FROM q WHERE rn = 1",
    "t_vis delta_t alpha",
)(lambda s: A.align_keywords(*tables(s), s("fx_concepts"), threshold=None).select(*COLS))
#: Pairs of spoken and shown tokens above the similarity of the cascade, and what is shown named by what it matches.
PAIRS = f"""pv AS (SELECT DISTINCT k.video_id, k.keyword_text AS a, o.tok AS b FROM (SELECT DISTINCT video_id, keyword_text FROM {KW} x WHERE groundability <> 'LOW') k JOIN (SELECT DISTINCT video_id, tok FROM fx_ocr) o USING (video_id)),
sm AS (SELECT pv.video_id, pv.a AS part, pv.b AS tok, g.r AS ratio FROM pv JOIN {sqltext.similar('pv', 0.8, '>')} g ON g.a=pv.a AND g.b=pv.b)"""
FUZZY = BASE.replace("JOIN fx_ocr o", "JOIN oc o").replace("FROM fx_ocr o WHERE", "FROM oc o WHERE").replace("WITH k AS", f"WITH {PAIRS}, oc AS (SELECT DISTINCT o.video_id, o.frame_time, sm.part AS tok FROM fx_ocr o JOIN sm USING (video_id, tok)), k AS")
register(
    "a7_cascade_fuzzy",
    FUZZY
    + f", u AS (SELECT *, 0 AS r FROM ({AD}) UNION ALL SELECT *, 1 FROM ({case_sql('b', chr(39) + 'B' + chr(39), '1e0')}) UNION ALL SELECT *, 2 FROM ({case_sql('c', chr(39) + 'C' + chr(39), '0.8e0', '10e0')}) UNION ALL SELECT video_id, keyword_id, NULL, NULL, 'F', 0e0, NULL, 9 FROM {KW} z), q AS (SELECT *, row_number() OVER (PARTITION BY video_id, keyword_id ORDER BY r) AS rn FROM u) SELECT {', '.join(COLS)} FROM q WHERE rn = 1",
    "t_vis delta_t alpha",
)(lambda s: A.align_keywords(*tables(s)).select(*COLS))
register("j8_fuzzy_word_match", f"WITH {PAIRS} SELECT video_id, part, tok, ratio FROM sm", "ratio")(lambda s: A.fuzzy_word_match(A.keyword_parts(able(s)), s("fx_ocr")))


#: The cases for keywords of two words: all words on one frame (or in the scene) match fully, one of four letters partly.
PW = KW.replace("fx_keywords", "fx_phrases")
PHRASES = f"""WITH k AS (SELECT * FROM {PW} x WHERE groundability <> 'LOW'), sc AS (SELECT * FROM fx_scenes),
pt AS (SELECT video_id, keyword_id, t_narr, unnest(list_distinct(string_split(keyword_text, ' '))) AS part FROM k),
nn AS (SELECT video_id, keyword_id, count(*) AS n_needed FROM pt GROUP BY 1, 2),
cur AS (SELECT * FROM (SELECT k.*, s.scene_id, s.t_start, s.t_end, row_number() OVER (PARTITION BY k.video_id, k.keyword_id ORDER BY CASE WHEN k.t_narr BETWEEN s.t_start AND s.t_end THEN 0 ELSE 1 END, CASE WHEN k.t_narr BETWEEN s.t_start AND s.t_end THEN 0 ELSE abs((s.t_start+s.t_end)/2-k.t_narr) END, s.scene_id) AS rn FROM k JOIN sc s USING (video_id)) WHERE rn = 1),
am AS (SELECT pt.video_id, pt.keyword_id, o.frame_time, list(DISTINCT part) AS ps, bool_or(length(part) >= 4) AS single FROM pt JOIN cur USING (video_id, keyword_id) JOIN fx_ocr o ON o.video_id=pt.video_id AND o.tok=pt.part AND o.frame_time BETWEEN cur.t_start AND cur.t_end GROUP BY 1, 2, 3),
an AS (SELECT video_id, keyword_id, n_needed, min(frame_time) FILTER (len(ps) = n_needed OR single) AS first, len(list_distinct(flatten(list(ps)))) AS n_union, bool_or(single) AS loose FROM am JOIN nn USING (video_id, keyword_id) GROUP BY 1, 2, 3),
a AS (SELECT cur.video_id, cur.keyword_id, cur.t_narr, cur.scene_id, t_start, t_end, n_union = n_needed AS whole, coalesce(first, t_start) AS t_vis FROM an JOIN cur USING (video_id, keyword_id) WHERE n_union = n_needed OR loose),
fm AS (SELECT pt.video_id, pt.keyword_id, pt.t_narr, o.frame_time, count(DISTINCT part) = n_needed AS whole, bool_or(length(part) >= 4) AS loose FROM pt JOIN nn USING (video_id, keyword_id) JOIN fx_ocr o ON o.video_id=pt.video_id AND o.tok=pt.part AND o.frame_time BETWEEN pt.t_narr-10 AND pt.t_narr+10 GROUP BY 1, 2, 3, 4, n_needed),
bf AS (SELECT video_id, keyword_id, t_narr, coalesce(min(frame_time) FILTER (whole), min(frame_time) FILTER (loose)) AS seen, bool_or(whole) AS whole FROM fm WHERE (whole OR loose) AND frame_time >= t_narr+1 GROUP BY 1, 2, 3),
bs AS (SELECT * FROM (SELECT bf.*, s.scene_id, s.t_start, s.t_end, row_number() OVER (PARTITION BY bf.video_id, bf.keyword_id ORDER BY CASE WHEN seen BETWEEN s.t_start AND s.t_end THEN 0 ELSE 1 END, CASE WHEN seen BETWEEN s.t_start AND s.t_end THEN 0 ELSE abs((s.t_start+s.t_end)/2-seen) END, s.scene_id) AS rn FROM bf JOIN sc s USING (video_id)) WHERE rn = 1),
fr AS (SELECT DISTINCT video_id, frame_time FROM fx_ocr),
bn AS (SELECT * FROM (SELECT bs.*, f.frame_time AS sf, row_number() OVER (PARTITION BY bs.video_id, bs.keyword_id ORDER BY abs(f.frame_time-bs.t_start), f.frame_time) AS r2 FROM bs LEFT JOIN fr f ON f.video_id=bs.video_id AND f.frame_time BETWEEN bs.t_start-1 AND bs.t_start+1) WHERE r2 = 1),
bw AS (SELECT bn.video_id, bn.keyword_id, count(DISTINCT pt.part) AS n FROM bn JOIN pt USING (video_id, keyword_id) JOIN fx_ocr o ON o.video_id=bn.video_id AND o.frame_time=bn.sf AND o.tok=pt.part GROUP BY 1, 2),
b AS (SELECT bn.video_id, bn.keyword_id, bn.t_narr, bn.whole, CASE WHEN bw.n = nn.n_needed THEN t_start ELSE seen END AS t_vis, scene_id, t_start, t_end FROM bn JOIN nn USING (video_id, keyword_id) LEFT JOIN bw USING (video_id, keyword_id)),
cf AS (SELECT video_id, keyword_id, t_narr, max(frame_time) AS seen FROM fm WHERE whole AND frame_time < t_narr-1 GROUP BY 1, 2, 3),
c AS (SELECT video_id, keyword_id, t_narr, t_start AS t_vis, scene_id, t_start, t_end FROM (SELECT cf.*, s.scene_id, s.t_start, s.t_end, row_number() OVER (PARTITION BY cf.video_id, cf.keyword_id ORDER BY CASE WHEN seen BETWEEN s.t_start AND s.t_end THEN 0 ELSE 1 END, CASE WHEN seen BETWEEN s.t_start AND s.t_end THEN 0 ELSE abs((s.t_start+s.t_end)/2-seen) END, s.scene_id) AS rn FROM cf JOIN sc s USING (video_id)) WHERE rn = 1 AND t_end < t_narr) """
MORE = [*COLS, "match_method", "confidence", "sub_scene_onset", "gap_since_expired"]
ROUNDED = "t_vis delta_t alpha sub_scene_onset gap_since_expired"


def phrase_case(t: str, case: str, method: str, delta: str = "t_vis - t_narr", alpha: str = "CASE WHEN whole THEN 1e0 ELSE 0.8e0 END", confidence: str = "CASE WHEN whole THEN 'HIGH' ELSE 'MEDIUM' END", onset: str = "NULL", gap: str = "NULL") -> str:
    return f"SELECT video_id, keyword_id, t_vis, {delta} AS delta_t, {case} AS match_case, {alpha} AS alpha, scene_id, {method} AS match_method, {confidence} AS confidence, CAST({onset} AS DOUBLE) AS sub_scene_onset, CAST({gap} AS DOUBLE) AS gap_since_expired FROM {t}"


HALF = "CASE WHEN whole THEN 'full' ELSE 'partial' END"
P_AD = phrase_case("a", "CASE WHEN t_vis <= t_start + 1 THEN 'A' ELSE 'D' END", f"'ocr_at_tnarr_' || {HALF}", onset="CASE WHEN t_vis > t_start + 1 THEN t_vis END")
P_B = phrase_case("b", "'B'", f"'ocr_forward_' || {HALF}")
P_C = phrase_case("c", "'C'", "'ocr_backward_expired'", "10e0", "0.8e0", "'MEDIUM'", gap="t_narr - t_end")
register("a1_case_a_d_phrases", PHRASES + P_AD, ROUNDED)(lambda s: A.case_a_d(*parts(s, "fx_phrases")).select(*MORE))
register("a2_case_b_forward_phrases", PHRASES + P_B, ROUNDED)(lambda s: A.case_b_forward(*parts(s, "fx_phrases")).select(*MORE))
register("a3_case_c_backward_phrases", PHRASES + P_C, ROUNDED)(lambda s: A.case_c_backward(*parts(s, "fx_phrases")).select(*MORE))
#: Concepts against phrases by the token-set ratio: shared words, and what either has besides.
SPLIT = "list_sort(list_distinct(string_split({}, ' ')))"
LESS = "array_to_string(list_filter({}, lambda w: NOT list_contains({}, w)), ' ')"
CONCEPTS = f"""ep AS (SELECT k.video_id, k.keyword_id, k.t_narr, k.keyword_text AS one, x.concept AS two, x.scene_id, x.t_start, x.t_end FROM k JOIN fx_phrase_concepts x ON x.video_id=k.video_id AND x.t_keyframe BETWEEN k.t_narr-10 AND k.t_narr+10),
ed AS (SELECT DISTINCT one, two, {SPLIT.format('one')} AS x, {SPLIT.format('two')} AS y FROM ep),
ee AS (SELECT one, two, array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' ') AS common, {LESS.format('x', 'y')} AS l, {LESS.format('y', 'x')} AS r FROM ed),
ef AS (SELECT *, trim(common || ' ' || l) AS ol, trim(common || ' ' || r) AS o2 FROM ee),
eg AS (SELECT one, two, CASE WHEN contains(one, two) OR contains(two, one) OR (common <> '' AND (l = '' OR r = '')) THEN 100e0 ELSE greatest(CASE WHEN {sqltext.may_reach('ol', 'o2', 0.75)} THEN 100*({sqltext.ratio('ol', 'o2')}) ELSE 0e0 END, CASE WHEN common = '' THEN 0e0 ELSE 100*({sqltext.ratio('common', 'ol')}) END, CASE WHEN common = '' THEN 0e0 ELSE 100*({sqltext.ratio('common', 'o2')}) END) END AS score FROM ef),
e AS (SELECT video_id, keyword_id, t_narr, t_start AS t_vis, scene_id, score FROM (SELECT ep.*, eg.score, row_number() OVER (PARTITION BY video_id, keyword_id ORDER BY score DESC, scene_id, two) AS rn FROM ep JOIN eg USING (one, two) WHERE score >= 75) WHERE rn = 1) """
P_E = phrase_case("e", "'E'", "CASE WHEN score >= 100 THEN 'concept_exact' ELSE 'concept_fuzzy' END", alpha="least(0.9e0, 0.6e0 + 0.3e0 * score / 100)", confidence="CASE WHEN score >= 90 THEN 'HIGH' ELSE 'MEDIUM' END")
register("a4_case_e_concept_fuzzy", PHRASES + ", " + CONCEPTS + P_E, ROUNDED)(lambda s: A.case_e_concept(able(s, "fx_phrases"), s("fx_phrase_concepts")).select(*MORE))


def phrase_vectors(s):
    """Keywords and scenes with a vector each, out of the table of vectors."""
    v = s("embeddings").select(F.col("vec_id").alias("v_"), "embedding")
    n = v.agg(F.max("v_").alias("top"))
    k = keywords(s, "fx_phrases").join(F.broadcast(n)).withColumn("v_", F.col("keyword_id") * 7 % (F.col("top") + 1)).join(v, "v_").select("video_id", "keyword_id", "t_narr", F.transform("embedding", lambda x: x * 4).alias("embedding"), "groundability")
    c = s("fx_scenes").join(F.broadcast(n)).withColumn("v_", F.col("scene_id") * 11 % (F.col("top") + 1)).join(v, "v_").select("video_id", "scene_id", "t_start", "t_end", "t_keyframe", "embedding", (F.col("scene_id") % 3 == 1).alias("has_words"))
    return settled(k, "keyword-vectors"), settled(c, "scene-vectors")


VECTORS = """kv AS (SELECT k.video_id, k.keyword_id, k.t_narr, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM k JOIN embeddings ON vec_id = keyword_id * 7 % (SELECT max(vec_id) + 1 FROM embeddings)),
cv AS (SELECT s.*, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS b, scene_id % 3 = 1 AS has_words FROM sc s JOIN embeddings ON vec_id = scene_id * 11 % (SELECT max(vec_id) + 1 FROM embeddings)),
gp AS (SELECT kv.video_id, keyword_id, t_narr, scene_id, t_start AS t_vis, t_keyframe, has_words, 1/(1+exp(-4*list_dot_product(a, b))) AS sim FROM kv JOIN cv ON cv.video_id=kv.video_id AND t_keyframe BETWEEN t_narr-10 AND t_narr+10),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, keyword_id ORDER BY sim*exp(-0.5e0*power((t_keyframe-t_narr)/5e0, 2)) DESC, scene_id) AS rn FROM gp) WHERE rn = 1 AND sim >= 0.55e0) """
P_G = phrase_case("g", "'G'", "'vector'", alpha="greatest(0.1e0, least(0.5e0, (CASE WHEN has_words THEN 0.25e0 ELSE 0.4e0 END)*least(1e0, (sim-0.55e0)/0.05e0)))", confidence="'LOW'")
P_F = f"SELECT k.video_id, k.keyword_id, NULL, NULL, 'F', 0e0, NULL, CASE WHEN groundability='LOW' THEN 'low_groundability' WHEN NOT EXISTS (SELECT 1 FROM fx_ocr o WHERE o.video_id=k.video_id AND o.frame_time BETWEEN k.t_narr-10 AND k.t_narr+10) THEN 'no_ocr_nearby' ELSE 'ocr_vocabulary_mismatch' END, 'NONE', NULL, NULL FROM {PW} k"
#: Shown tokens named by the part that they resemble.
NEAR = f"""pv AS (SELECT DISTINCT k.video_id, k.part AS a, o.tok AS b FROM (SELECT DISTINCT video_id, unnest(string_split(keyword_text, ' ')) AS part FROM {PW} x WHERE groundability <> 'LOW') k JOIN (SELECT DISTINCT video_id, tok FROM fx_ocr) o USING (video_id)),
sm AS (SELECT pv.video_id, pv.a AS part, pv.b AS tok FROM pv JOIN {sqltext.similar('pv', 0.8, '>')} g ON g.a=pv.a AND g.b=pv.b)"""
BOTH = PHRASES.replace("JOIN fx_ocr o", "JOIN oc o").replace("WITH k AS", f"WITH {NEAR}, oc AS (SELECT DISTINCT o.video_id, o.frame_time, sm.part AS tok FROM fx_ocr o JOIN sm USING (video_id, tok)), k AS")
CASES = [P_AD, P_B, P_C, P_E, P_G, P_F]
register(
    "a7_cascade_phrases",
    BOTH + ", " + CONCEPTS + ", " + VECTORS + f", u AS ({' UNION ALL '.join(f'SELECT *, {i} AS r FROM ({c})' for i, c in enumerate(CASES))}), q AS (SELECT *, row_number() OVER (PARTITION BY video_id, keyword_id ORDER BY r) AS rn FROM u) SELECT {', '.join(MORE)} FROM q WHERE rn = 1",
    ROUNDED,
)(lambda s: A.align_keywords(*tables(s, "fx_phrases"), s("fx_phrase_concepts"), phrase_vectors(s)).select(*MORE))


register(
    "f6_multiword_match",
    f"WITH {NEAR}, pt AS (SELECT video_id, keyword_id, unnest(list_distinct(string_split(keyword_text, ' '))) AS part FROM {PW} x WHERE groundability <> 'LOW'), ok AS (SELECT DISTINCT video_id, part, TRUE AS hit FROM sm) SELECT pt.video_id, keyword_id, count(*) = count(hit) AS matched FROM pt LEFT JOIN ok USING (video_id, part) GROUP BY 1, 2",
)(lambda s: A.multiword_match(able(s, "fx_phrases"), s("fx_ocr").select("video_id", "tok").distinct()))


def vector_keywords(s):
    f = s("fx_frames")
    k = f.select("video_id", F.col("frame_idx").cast("long").alias("keyword_id"), F.col("frame_time").alias("t_narr"), F.transform("embedding", lambda x: x * 4).alias("embedding"), F.when(F.col("frame_idx") % 9 == 0, "LOW").otherwise("HIGH").alias("groundability"))
    c = f.select("video_id", F.col("frame_idx").alias("scene_id"), (F.col("frame_time") - 1).alias("t_start"), (F.col("frame_time") + 1).alias("t_end"), F.col("frame_time").alias("t_keyframe"), "embedding", (F.col("frame_idx") % 8 == 1).alias("has_words"))
    return k, c


VEC = "k AS (SELECT video_id, CAST(frame_idx AS BIGINT) AS keyword_id, frame_time AS t_narr, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS kv FROM fx_frames WHERE frame_idx % 9 <> 0), c AS (SELECT video_id, frame_idx AS scene_id, frame_time - 1 AS t_start, frame_time AS t_keyframe, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS sv, frame_idx % 8 = 1 AS has_words FROM fx_frames)"
register(
    "a5_case_g_vector",
    f"WITH {VEC}, p AS (SELECT k.video_id, k.keyword_id, k.t_narr, c.*  EXCLUDE (video_id), 1/(1+exp(-4*list_dot_product(kv, sv))) AS sim FROM k JOIN c ON c.video_id=k.video_id AND c.t_keyframe BETWEEN k.t_narr-10 AND k.t_narr+10), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, keyword_id ORDER BY sim*exp(-0.5e0*power((t_keyframe-t_narr)/5e0, 2)) DESC, scene_id) AS rn FROM p) SELECT video_id, keyword_id, t_start AS t_vis, t_start-t_narr AS delta_t, 'G' AS match_case, greatest(0.1e0, least(0.5e0, (CASE WHEN has_words THEN 0.25e0 ELSE 0.4e0 END)*least(1e0, (sim-0.55e0)/0.05e0))) AS alpha, scene_id FROM r WHERE rn=1 AND sim >= 0.55e0",
    "t_vis delta_t alpha",
)(lambda s: A.case_g_vector(*vector_keywords(s)).select(*COLS))
SW = "sw AS (SELECT s.video_id, s.scene_id, s.t_start AS t_vis, o.tok FROM fx_scenes s JOIN fx_ocr o ON o.video_id=s.video_id AND o.frame_time=s.t_start), w AS (SELECT video_id, keyword_text AS tok, t_narr AS t FROM fx_keywords), p AS (SELECT sw.*, w.t, row_number() OVER (PARTITION BY sw.video_id, sw.scene_id, sw.tok ORDER BY abs(w.t-sw.t_vis), w.t) AS rn FROM sw JOIN w ON w.video_id=sw.video_id AND w.tok=sw.tok AND abs(w.t-sw.t_vis) <= 30), ta AS (SELECT video_id, scene_id, t_vis, median(t-t_vis) AS delta_narr_vis, string_agg(tok, ' ' ORDER BY tok) AS matched_words FROM p WHERE rn=1 GROUP BY 1,2,3)"


def scene_tokens(s):
    rows = s("fx_scenes").select("video_id", "scene_id", F.col("t_start").alias("t_vis"))
    return rows.join(large(s("fx_ocr").withColumnRenamed("frame_time", "t_vis")), ["video_id", "t_vis"])


def spoken(s):
    return s("fx_keywords").select("video_id", F.col("keyword_text").alias("tok"), F.col("t_narr").alias("t"))


register("j7_a9_scene_track_a", f"WITH {SW} SELECT *, 'A' AS match_track, 1e0 AS alpha FROM ta", "t_vis delta_narr_vis alpha")(lambda s: A.scene_track_a(scene_tokens(s), spoken(s)))
register("j7_first_in_window", f"WITH {SW}, f AS (SELECT sw.video_id, sw.scene_id, sw.t_vis, w.t, w.tok, row_number() OVER (PARTITION BY sw.video_id, sw.scene_id ORDER BY w.t, w.tok) AS r FROM sw JOIN w ON w.video_id=sw.video_id AND w.tok=sw.tok AND abs(w.t-sw.t_vis) <= 60) SELECT video_id, scene_id, t_vis, t-t_vis AS delta_narr_vis, tok AS matched_words FROM f WHERE r=1", "t_vis delta_narr_vis")(
    lambda s: A.first_in_window(scene_tokens(s), spoken(s))
)


def vector_scenes(s):
    f = settled(s("fx_frames"), "vector-frames")  # numbered once: scenes and segments read it several times
    a = f.select("video_id", F.col("frame_idx").alias("scene_id"), F.col("frame_time").alias("t_vis"), "embedding", (F.col("frame_idx") % 12 != 1).alias("is_content"))
    b = f.select("video_id", F.col("frame_idx").cast("long").alias("segment_id"), F.col("frame_time").alias("t_mid"), "embedding")
    return a, b


TV = "a AS (SELECT video_id, frame_idx AS scene_id, frame_time AS t_vis, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, frame_idx % 12 <> 1 AS is_content FROM fx_frames), b AS (SELECT video_id, CAST(frame_idx AS BIGINT) AS segment_id, frame_time AS t_mid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS u FROM fx_frames), p AS (SELECT a.video_id, scene_id, t_vis, segment_id, t_mid, list_cosine_similarity(v, u) AS sim FROM a JOIN b USING (video_id)), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, scene_id ORDER BY sim*exp(-0.5e0*power((t_mid-t_vis)/15e0, 2)) DESC, segment_id) AS rn FROM p), tv AS (SELECT video_id, scene_id, t_vis, segment_id, t_mid-t_vis AS delta_narr_vis, 'vector' AS match_track, 0.5e0+0.5e0*least(greatest((sim-0.2e0)/0.8e0, 0), 1) AS alpha FROM r WHERE rn=1 AND sim >= 0.2e0)"
register("a10_scene_track_vector", f"WITH {TV} SELECT * FROM tv", "t_vis delta_narr_vis alpha")(lambda s: A.scene_track_vector(*vector_scenes(s)))


def vector_windows(s):
    """Runs inside a segment: the vectors of its own frame and of the two after it."""
    return s("fx_frames").select("video_id", F.col("frame_idx"), (F.col("frame_time") + 0.1).alias("t_center"), "embedding", F.explode(F.array(*map(F.lit, range(3)))).alias("window_id")).select(
        "video_id", (F.col("frame_idx") - F.col("window_id")).cast("long").alias("segment_id"), "window_id", "t_center", "embedding"
    )


register(
    "a10_scene_track_windows",
    f"WITH {TV}, wn AS (SELECT video_id, CAST(frame_idx - i AS BIGINT) AS segment_id, i AS window_id, frame_time + 0.1e0 AS t_center, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM fx_frames, (SELECT unnest([0, 1, 2]) AS i)), rn AS (SELECT tv.video_id, tv.scene_id, t_center, row_number() OVER (PARTITION BY tv.video_id, tv.scene_id ORDER BY list_cosine_similarity(a.v, z) DESC, window_id) AS k FROM tv JOIN a USING (video_id, scene_id) JOIN wn USING (video_id, segment_id)) SELECT tv.video_id, tv.scene_id, tv.t_vis, tv.segment_id, t_center - tv.t_vis AS delta_narr_vis, match_track, alpha FROM tv JOIN rn ON rn.video_id = tv.video_id AND rn.scene_id = tv.scene_id AND k = 1",
    "t_vis delta_narr_vis alpha",
)(lambda s: A.scene_track_vector(*vector_scenes(s), windows=vector_windows(s)))
def vector_cascade(s):
    """Two tracks over the same vectors share their matches."""
    scenes, segments = vector_scenes(s)
    matches = A.vector_matches(scenes, segments)
    return A.scene_cascade(scenes.select("video_id", "scene_id", "is_content"), [A.vector_track(matches), A.vector_track(matches, least=0.9, track="text")])


register(
    "a11_scene_cascade",
    f"WITH {TV} SELECT a.video_id, a.scene_id, CASE WHEN NOT is_content THEN 'non_content' WHEN tv.scene_id IS NULL THEN 'no_match' ELSE 'match' END AS match_type, CASE WHEN is_content THEN delta_narr_vis END AS delta_narr_vis, CASE WHEN is_content THEN match_track END AS match_track, CASE WHEN is_content THEN coalesce(alpha, 0e0) END AS alpha FROM a LEFT JOIN tv USING (video_id, scene_id)",
    "delta_narr_vis alpha",
)(vector_cascade)


#: Groundable keywords of either kind, and what the other steps were given: two detections for one keyword in seven, two
#: pictures for one in nine, answers for one in four, a check of neighbouring frames for one in fourteen.
GROUNDABILITY = "CASE WHEN keyword_id % 5 = 0 THEN 'LOW' WHEN keyword_id % 3 = 1 THEN 'MEDIUM' ELSE 'HIGH' END"


def grounding(view):
    def build(s):
        k = settled(s(view).withColumn("groundability", F.expr(GROUNDABILITY)), "grounding")
        ocr, i, t = settled(A.shown(s("fx_ocr")), "grounding"), F.col("keyword_id"), F.col("t_narr")
        hits = A.token_hits(k, ocr, None)

        def given(of, *rows):
            """Rows of (time from the word, value)."""
            each = F.explode(F.array(*[F.struct(F.lit(float(d)).alias("d"), v.cast("double").alias("value")) for d, v in rows]))
            return k.where(i % of == 0).select("video_id", "keyword_id", "t_narr", each.alias("x")).select("video_id", "keyword_id", (t + F.col("x.d")).alias("t"), "x.value")

        seen = given(7, (5, F.lit(0.5)), (-4, F.lit(0.3))).withColumn("area", F.lit(4.0))
        alike = given(9, (20, F.lit(0.9)), (2, i % 10 / 10), (31, F.lit(3.0)))
        asked = given(4, (1, F.lit(1)), (-3, i % 8)).select("video_id", "keyword_id", "t", (F.col("value") == 1).alias("yes"))
        passing = k.where(i % 14 == 0).select("video_id", "keyword_id", F.lit(True).alias("is_transient"))
        return A.keyword_grounding(k, hits, ocr, seen, alike, asked, passing)

    return build


def grounding_sql(view: str) -> str:
    return f"""k AS (SELECT *, {GROUNDABILITY} AS groundability FROM {view}), ab AS (SELECT * FROM k WHERE groundability <> 'LOW'),
pt AS (SELECT DISTINCT video_id, keyword_id, t_narr, unnest(string_split(keyword_text, ' ')) AS part FROM ab), nd AS (SELECT video_id, keyword_id, count(*) AS n FROM pt GROUP BY 1, 2),
fu AS (SELECT pt.video_id, pt.keyword_id, pt.t_narr, o.frame_time FROM pt JOIN fx_ocr o ON o.video_id = pt.video_id AND o.tok = pt.part AND abs(o.frame_time - pt.t_narr) <= 60 JOIN nd ON nd.video_id = pt.video_id AND nd.keyword_id = pt.keyword_id GROUP BY 1, 2, 3, 4, nd.n HAVING count(DISTINCT part) = nd.n),
tx AS (SELECT video_id, keyword_id, frame_time FROM (SELECT *, row_number() OVER (PARTITION BY video_id, keyword_id ORDER BY abs(frame_time - t_narr), frame_time) AS rn FROM fu) WHERE rn = 1),
m AS (SELECT ab.*, tx.frame_time, CASE WHEN frame_time IS NOT NULL THEN 'ocr' WHEN keyword_id % 7 = 0 THEN 'grounding_dino'
 WHEN keyword_id % 9 = 0 THEN 'siglip_contextual' WHEN keyword_id % 4 = 0 AND groundability = 'HIGH' THEN 'vlm_classification' ELSE 'not_found' END AS method FROM ab LEFT JOIN tx USING (video_id, keyword_id)),
v AS (SELECT *, CASE method WHEN 'ocr' THEN frame_time WHEN 'grounding_dino' THEN t_narr + 5 WHEN 'siglip_contextual' THEN t_narr + CASE WHEN (keyword_id % 10)/10e0*exp(-0.5e0*power(2/15e0, 2)) > 0.9e0*exp(-0.5e0*power(20/15e0, 2)) THEN 2 ELSE 20 END WHEN 'vlm_classification' THEN t_narr + CASE WHEN keyword_id % 8 = 1 THEN -3 ELSE 1 END END AS t_vis FROM m),
gr AS (SELECT video_id, keyword_id, groundability, t_narr, t_vis, t_vis - t_narr AS delta_t, method, CASE method WHEN 'ocr' THEN 'HIGH' WHEN 'grounding_dino' THEN 'MEDIUM' WHEN 'not_found' THEN 'NONE' ELSE 'LOW' END AS confidence, CASE WHEN method = 'grounding_dino' THEN 4e0 END AS bbox_area, method NOT IN ('ocr', 'not_found') AND keyword_id % 14 = 0 AS is_transient, t_vis IS NOT NULL AS is_visual, method = 'vlm_classification' AS flag_for_review FROM v
UNION ALL SELECT video_id, keyword_id, groundability, t_narr, NULL, NULL, 'skipped_low_groundability', 'NONE', NULL, FALSE, FALSE, FALSE FROM k WHERE groundability = 'LOW')"""


for view, name in (("fx_keywords", "a12_keyword_grounding"), ("fx_phrases", "a12_keyword_grounding_phrases")):
    register(name, f"WITH {grounding_sql(view)} SELECT * FROM gr", "t_narr t_vis delta_t bbox_area")(grounding(view))
register(
    "a12_grounding_by_segment",
    f"""WITH {grounding_sql("fx_keywords")}, g AS (SELECT gr.*, CAST(floor(keyword_id/12) AS BIGINT) AS segment_id, CASE confidence WHEN 'HIGH' THEN 1e0 WHEN 'MEDIUM' THEN 0.7e0 WHEN 'LOW' THEN 0.4e0 ELSE 0.5e0 END AS w FROM gr),
c AS (SELECT *, sum(w) OVER (PARTITION BY video_id, segment_id ORDER BY delta_t) AS cum, sum(w) OVER (PARTITION BY video_id, segment_id) AS tot FROM g WHERE delta_t IS NOT NULL), md AS (SELECT video_id, segment_id, min(delta_t) FILTER (cum >= tot/2) AS delta_t_weighted_median FROM c GROUP BY 1, 2)
SELECT g.video_id, g.segment_id, count(*) AS n_keywords, count(*) FILTER (groundability <> 'LOW') AS n_groundable, count(*) FILTER (is_visual) AS n_grounded, count(*) FILTER (NOT is_visual) AS n_not_visual, avg(delta_t) AS delta_t_mean, stddev_pop(delta_t) AS delta_t_std, min(delta_t_weighted_median) AS delta_t_weighted_median FROM g LEFT JOIN md USING (video_id, segment_id) GROUP BY 1, 2""",
    "delta_t_mean delta_t_std delta_t_weighted_median",
)(lambda s: A.grounding_by_segment(grounding("fx_keywords")(s).withColumn("segment_id", F.floor(F.col("keyword_id") / 12).cast("long"))))
register(
    "w23_monotonic_violations",
    "WITH v AS (SELECT *, coalesce(t_narr < lag(t_narr) OVER (PARTITION BY video_id ORDER BY t_vis, keyword_id, segment_id, t_narr, alpha) - 10, FALSE) AS v FROM fx_align WHERE match_case <> 'F') SELECT video_id, count(*) FILTER (v) AS n_violations, count(*) AS n FROM v GROUP BY 1",
)(lambda s: A.monotonic_violations(s("fx_align").where("match_case <> 'F'")).groupBy("video_id").agg(F.count_if("violates").alias("n_violations"), F.count(F.lit(1)).alias("n")))
