"""Queries on words, segments, keywords and time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import text as T
from ..operators import timejoin as J
from ..sources import tables
from ..sources.shared import large, settled
from . import sqltext
from .registry import register

N = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
LISTS = {"VISUAL": T.VISUAL_NOUNS, "DOMAIN": T.DOMAIN_TERMS, "ABSTRACT": T.ABSTRACT_WORDS, "VAGUE": T.VAGUE_NOUNS, "STOP": T.STOP_WORDS}


def sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


FLAGGED = """WITH l AS (SELECT *, lag(start_time) OVER w AS ps, lag(end_time) OVER w AS pe FROM fx_words WINDOW w AS (PARTITION BY video_id ORDER BY word_id)),
f AS (SELECT *, CASE WHEN start_time IS NULL OR end_time IS NULL THEN 'missing' WHEN end_time-start_time < 0.05e0 OR end_time-start_time > 2e0 THEN 'duration' WHEN start_time-pe > 3e0 THEN 'gap' WHEN start_time < ps THEN 'order' END AS reason FROM l) """
register("p1_with_midpoint", "SELECT video_id, segment_id, (start_time+end_time)/2 AS t_mid FROM fx_segments", "t_mid")(lambda s: T.with_midpoint(s("fx_segments")).select("video_id", "segment_id", "t_mid"))
register("p3_flag_bad_timestamps", FLAGGED + "SELECT video_id, word_id, reason, reason IS NULL AS timestamp_reliable FROM f")(lambda s: T.flag_bad_timestamps(s("fx_words")).select("video_id", "word_id", "reason", "timestamp_reliable"))
register(
    "g13_transcript_quality",
    FLAGGED + """SELECT video_id, count(*) AS n_words, count(*) FILTER (reason='missing') AS n_missing, count(*) FILTER (reason='duration') AS n_duration, count(*) FILTER (reason='gap') AS n_gap, count(*) FILTER (reason='order') AS n_order,
 avg(end_time-start_time) AS mean_duration, max(end_time-start_time) AS max_duration, avg(start_time-pe) AS mean_gap, max(start_time-pe) AS max_gap, max(end_time)-min(start_time) AS span FROM f GROUP BY 1""",
    "mean_duration max_duration mean_gap max_gap span",
)(lambda s: tables.transcript_quality(s("fx_words")))
register("g22_transcript_stats", "WITH g AS (SELECT video_id, count(*) AS n_segments, sum(n_words) AS n_words, max(end_time) AS duration FROM fx_segments GROUP BY 1) SELECT video_id, n_words::BIGINT AS n_words, n_segments, duration, n_words/n_segments AS words_per_segment FROM g", "duration words_per_segment")(
    lambda s: tables.transcript_stats(s("fx_segments"))
)
SENT = "WITH b AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM fx_words), r AS (SELECT video_id, CAST(g AS BIGINT) AS segment_id, string_agg(word, ' ' ORDER BY word_id) AS text, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS n_words FROM b GROUP BY 1, 2) "
register("t1_resegment_sentences", SENT + "SELECT * FROM r", "start_time end_time")(lambda s: T.resegment_sentences(s("fx_words")))
register(
    "t2_merge_short_segments",
    SENT + ", o AS (SELECT *, sum(CASE WHEN n_words >= 4 OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY segment_id) - 1 AS n FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY segment_id) AS rn FROM r)) SELECT video_id, CAST(n AS BIGINT) AS segment_id, string_agg(text, ' ' ORDER BY segment_id) AS text, min(start_time) AS start_time, max(end_time) AS end_time, CAST(sum(n_words) AS BIGINT) AS n_words FROM o GROUP BY video_id, n",
    "start_time end_time",
)(lambda s: T.merge_short_segments(T.resegment_sentences(s("fx_words"))))
register(
    "t3_split_long_segments",
    f"""SELECT * FROM (WITH RECURSIVE b AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM fx_words),
q AS (SELECT video_id, g, list(word ORDER BY word_id) AS w, list(start_time ORDER BY word_id) AS a, list(end_time ORDER BY word_id) AS e FROM b GROUP BY 1, 2),
p AS (SELECT video_id, g, CAST(0 AS BIGINT) AS lo, CAST(len(w) AS BIGINT) AS hi FROM q UNION ALL SELECT video_id, g, CASE WHEN h = 0 THEN lo ELSE cut END, CASE WHEN h = 0 THEN cut ELSE hi END FROM
 (SELECT p.*, coalesce(list_min(list_transform(list_filter(range(lo + 1, hi), lambda i: right(w[i], 1) IN (',', ';') OR list_contains({sql_list(T.CONJUNCTIONS)}, lower(w[i + 1]))), lambda i: {{'d': abs(i - (lo + hi) // 2), 'i': i}})).i, (lo + hi) // 2) AS cut FROM p JOIN q USING (video_id, g) WHERE hi - lo > 12) x, (SELECT unnest([0, 1]) AS h) y)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY g, lo) - 1 AS segment_id, array_to_string(w[lo + 1:hi], ' ') AS text, list_min(a[lo + 1:hi]) AS start_time, list_max(e[lo + 1:hi]) AS end_time, hi - lo AS n_words FROM p JOIN q USING (video_id, g) WHERE hi - lo <= 12) z""",
    "start_time end_time",
)(lambda s: T.split_long_segments(T.sentence_numbers(s("fx_words")), 12))
WITH_SEG = "(SELECT *, CAST(floor(word_id/12) AS BIGINT) AS segment_id FROM fx_words)"
register(
    "t4_word_windows",
    f"WITH x AS (SELECT video_id, segment_id, word_id, list(word) OVER w AS ws, avg((start_time+end_time)/2) OVER w AS t, count(*) OVER w AS n, row_number() OVER (PARTITION BY video_id, segment_id ORDER BY word_id) AS rn FROM {WITH_SEG} WINDOW w AS (PARTITION BY video_id, segment_id ORDER BY word_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT video_id, segment_id, word_id, array_to_string(ws, ' ') AS text, t FROM x WHERE n = 3 OR rn = 1",
    "t",
)(lambda s: T.word_windows(s("fx_words").withColumn("segment_id", F.floor(F.col("word_id") / 12).cast("long"))))
register(
    "t5_keyword_candidates",
    f"""WITH w AS (SELECT video_id, segment_id, list_filter(list_transform(string_split_regex(text, '\\s+'), lambda x: lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g'))), lambda x: x <> '') AS w FROM fx_segments),
n AS (SELECT unnest([1, 2, 3]) AS n), g AS (SELECT video_id, segment_id, w[i:i+n-1] AS g FROM (SELECT *, unnest(range(1, len(w)-n+2)) AS i FROM w, n WHERE len(w) >= n)),
k AS (SELECT video_id, segment_id, array_to_string(g, ' ') AS keyword_text FROM g WHERE NOT list_has_any(g, {sql_list(T.STOP_WORDS)})), tf AS (SELECT *, count(*) AS tf FROM k WHERE length(keyword_text) >= 3 GROUP BY ALL),
df AS (SELECT video_id, keyword_text, count(*) AS df FROM tf GROUP BY ALL), ns AS (SELECT video_id, count(*) AS n FROM fx_segments GROUP BY 1),
r AS (SELECT *, tf*ln(n/df) AS score FROM tf JOIN df USING (video_id, keyword_text) JOIN ns USING (video_id)), o AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment_id ORDER BY round(score, 9) DESC, keyword_text) AS rk FROM r)
SELECT video_id, segment_id, keyword_text, score, CAST(rk AS INT) AS rank FROM o WHERE rk <= 5""".replace("'[^A-Za-z0-9]', '', 'g')", "'[^A-Za-z0-9]', '', 'g')"),
    "score",
)(lambda s: T.keyword_candidates(s("fx_segments")))
PAIRS = "SELECT a.video_id, a.segment_id, concat(a.keyword_text, ' ', b.keyword_text) AS keyword_text FROM fx_keywords a JOIN fx_keywords b ON a.video_id=b.video_id AND b.keyword_id=a.keyword_id+6"


def phrases(s):
    a, b = s("fx_keywords"), s("fx_keywords").select("video_id", (F.col("keyword_id") - 6).alias("keyword_id"), F.col("keyword_text").alias("b_"))
    two = a.join(b, ["video_id", "keyword_id"]).select("video_id", "segment_id", F.concat_ws(" ", "keyword_text", "b_").alias("keyword_text"))
    return two.unionByName(a.select("video_id", "segment_id", "keyword_text"))


register(
    "t6_merge_keywords",
    f"WITH p AS ({PAIRS} UNION ALL SELECT video_id, segment_id, keyword_text FROM fx_keywords), c AS (SELECT DISTINCT video_id, segment_id, lower(trim(keyword_text)) AS keyword_text FROM p WHERE length(trim(keyword_text)) >= 3 AND NOT list_contains({sql_list(T.STOP_WORDS)}, lower(trim(keyword_text)))), o AS (SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE a.video_id=b.video_id AND a.segment_id=b.segment_id AND contains(b.keyword_text, a.keyword_text) AND length(a.keyword_text) < length(b.keyword_text))), w AS (SELECT *, list_distinct(string_split_regex(keyword_text, '\\s+')) AS w FROM o) SELECT video_id, segment_id, keyword_text FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE a.video_id=b.video_id AND a.segment_id=b.segment_id AND len(a.w) < len(b.w) AND len(list_intersect(a.w, b.w)) > 0.5*len(a.w))",
)(lambda s: T.merge_keywords(phrases(s)))
register(
    "t7_assign_t_narr",
    f"""{FLAGGED}, k AS (SELECT k.video_id, k.keyword_id, k.segment_id, k.keyword_text AS f, g.start_time AS a, g.end_time AS b FROM fx_keywords k JOIN fx_segments g USING (video_id, segment_id)),
w AS (SELECT video_id, word_id, lower(word) AS w, {N.format('word')} AS n, start_time AS t, reason IS NULL AS ok FROM f WHERE start_time IS NOT NULL),
p AS (SELECT k.video_id, k.keyword_id, w.word_id, w.t, w.ok, CASE WHEN w.w = f THEN 1 WHEN w.n = f AND length(f) >= 3 THEN 2 WHEN length(f) >= 4 AND (contains(f, w.n) OR contains(w.n, f)) THEN 3 END AS step FROM k JOIN w ON w.video_id = k.video_id AND w.t BETWEEN k.a - 1e0 AND k.b + 1e0),
m AS (SELECT video_id, keyword_id, min({{'s': step, 'w': word_id, 't': t, 'ok': ok}}) AS m FROM p WHERE step IS NOT NULL GROUP BY 1, 2)
SELECT k.video_id, k.keyword_id, coalesce(m.m.t, (a+b)/2) AS t_narr_found, CASE m.m.s WHEN 1 THEN 'exact' WHEN 2 THEN 'normalized' WHEN 3 THEN 'substring' ELSE 'segment_midpoint' END AS t_narr_method, coalesce(m.m.ok, TRUE) AS t_narr_reliable FROM k LEFT JOIN m USING (video_id, keyword_id)""",
    "t_narr_found",
)(lambda s: T.assign_t_narr(s("fx_keywords"), T.flag_bad_timestamps(s("fx_words")), s("fx_segments")).select("video_id", "keyword_id", "t_narr_found", "t_narr_method", "t_narr_reliable"))
register(
    "t8_first_mention",
    f"""WITH k AS (SELECT *, CASE WHEN length({N.format('keyword_text')}) >= 3 THEN {N.format('keyword_text')} END AS tok FROM fx_keywords), f AS (SELECT video_id, tok, min(t_narr) AS t0 FROM k GROUP BY 1, 2)
SELECT k.video_id, k.keyword_id, k.tok IS NOT NULL AND NOT (f.t0 < k.t_narr AND k.t_narr - f.t0 <= 60) AS is_first_mention FROM k LEFT JOIN f ON f.video_id = k.video_id AND f.tok = k.tok""",
)(lambda s: T.first_mention(s("fx_keywords")).select("video_id", "keyword_id", "is_first_mention"))
register("t9_vocabulary", f"SELECT DISTINCT video_id, {N.format('word')} AS tok FROM fx_words WHERE length({N.format('word')}) >= 3")(lambda s: T.vocabulary(s("fx_words")))
register(
    "t10_correct_tokens",
    f"""WITH o AS (SELECT DISTINCT video_id, CASE WHEN length(tok) > 6 THEN tok || 'x' ELSE tok END AS tok FROM fx_ocr), v AS (SELECT DISTINCT video_id, {N.format('word')} AS word FROM fx_words WHERE length({N.format('word')}) >= 3),
odd AS (SELECT o.* FROM o ANTI JOIN v ON v.video_id = o.video_id AND v.word = o.tok), c AS (SELECT odd.video_id, odd.tok AS a, v.word AS b FROM odd JOIN v USING (video_id) WHERE length(word) BETWEEN ceil(length(tok)*0.7e0) AND floor(length(tok)/0.7e0)),
g AS (SELECT c.video_id, c.a, c.b, g.r FROM c JOIN {sqltext.similar('c', 0.75, '>=')} g ON g.a = c.a AND g.b = c.b), w AS (SELECT *, row_number() OVER (PARTITION BY video_id, a ORDER BY r DESC, b) AS rn FROM g) SELECT * FROM o UNION SELECT video_id, b FROM w WHERE rn = 1""",
)(lambda s: T.correct_tokens(s("fx_ocr").select("video_id", F.concat("tok", F.when(F.length("tok") > 6, F.lit("x")).otherwise(F.lit(""))).alias("tok")).distinct(), T.vocabulary(s("fx_words"))))
register(
    "t11_abbreviation_variants",
    """WITH c AS (SELECT DISTINCT video_id, lower(w) AS w FROM (SELECT video_id, regexp_replace(word, '[^A-Za-z0-9]', '', 'g') AS w FROM fx_words) WHERE length(w) >= 2 AND w = upper(w) AND regexp_matches(w, '[A-Z]')),
v AS (SELECT video_id, [w, array_to_string(string_split(w, ''), '-')] AS v FROM c), t AS (SELECT DISTINCT video_id, lower(word) AS tok FROM fx_words), m AS (SELECT t.video_id, unnest(v.v) AS tok FROM v JOIN t ON t.video_id = v.video_id AND list_contains(v.v, t.tok)) SELECT * FROM t UNION SELECT * FROM m""",
)(lambda s: T.abbreviation_variants(s("fx_words"), s("fx_words").select("video_id", F.lower("word").alias("tok")).distinct()))
SCENE_WORDS = "(SELECT s.video_id, s.scene_id, list_sort(list(DISTINCT o.tok) FILTER (o.tok IS NOT NULL AND s.scene_id % 3 <> 1)) AS words FROM fx_scenes s LEFT JOIN fx_ocr o ON o.video_id = s.video_id AND o.frame_time = s.t_start GROUP BY 1, 2)"


def scene_words(s):
    o = s("fx_ocr").withColumnRenamed("frame_time", "t_start")
    rows = s("fx_scenes").select("video_id", "scene_id", "t_start").join(large(o), ["video_id", "t_start"], "left")
    return rows.groupBy("video_id", "scene_id").agg(F.array_sort(F.collect_set(F.when(F.col("scene_id") % 3 != 1, F.col("tok")))).alias("words"))


register(
    "t12_new_words_per_scene",
    f"WITH s AS (SELECT video_id, scene_id, coalesce(words, []) AS words FROM {SCENE_WORDS}), b AS (SELECT *, coalesce(last_value(CASE WHEN len(words) > 0 THEN words END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS p FROM s) SELECT video_id, scene_id, array_to_string(list_filter(words, lambda x: NOT list_contains(p, x)), ' ') AS new_words FROM b",
)(lambda s: T.new_words_per_scene(scene_words(s)).select("video_id", "scene_id", F.array_join("new_words", " ").alias("new_words")))
register(
    "t13_t14_verb_and_discourse",
    "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{v}') THEN 0.5e0 ELSE 0e0 END AS verb, CASE WHEN regexp_matches(lower(text), '{d}') THEN 1e0 ELSE 0e0 END AS discourse FROM documents".format(v="|".join(T.INSTRUCTIONAL_VERBS), d="|".join(T.DISCOURSE_PATTERNS)),
    "verb discourse",
)(lambda s: s("documents").select("doc_id", T.instructional_verb_score(F.col("text")).alias("verb"), T.discourse_signal_score(F.col("text")).alias("discourse")))
GROUND = f"""WITH k AS (SELECT DISTINCT keyword_text AS k, string_split_regex(keyword_text, '\\s+') AS w FROM (SELECT keyword_text FROM fx_keywords UNION ALL SELECT keyword_text FROM ({PAIRS}))) SELECT k AS keyword_text, CASE WHEN list_has_any(w, {sql_list(T.VISUAL_NOUNS)}) THEN 'HIGH' WHEN len(list_filter({sql_list(T.DOMAIN_TERMS)}, lambda t: contains(k, t) OR contains(t, k))) > 0 THEN 'MEDIUM'
 WHEN len(w) = 1 AND list_contains({sql_list(T.ABSTRACT_WORDS + T.VAGUE_NOUNS)}, k) THEN 'LOW' WHEN len(w) = 1 AND length(k) <= 4 THEN 'LOW' WHEN len(w) = 1 THEN 'MEDIUM'
 WHEN len(list_filter(w, lambda x: NOT list_contains({sql_list(T.VAGUE_NOUNS + T.ABSTRACT_WORDS + T.STOP_WORDS)}, x) AND length(x) >= 3)) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS groundability FROM k"""
register("p4_groundability", GROUND)(lambda s: T.classify_keywords(phrases(s).select("keyword_text").distinct()))
#: A concreteness table over two thirds of the words: the mean of the words that it has decides where no list does.
register(
    "p4_groundability_concreteness",
    f"WITH g AS ({GROUND}), t AS (SELECT keyword_text, unnest(string_split_regex(keyword_text, '\\s+')) AS word FROM g), c AS (SELECT word, 1 + (length(word) * 7 % 17) / 4 AS score FROM (SELECT DISTINCT keyword_text AS word FROM fx_keywords) WHERE length(word) % 3 <> 0), m AS (SELECT keyword_text, avg(score) AS c FROM t JOIN c USING (word) GROUP BY 1) SELECT g.keyword_text, CASE WHEN m.c IS NULL OR list_has_any(string_split_regex(g.keyword_text, '\\s+'), {sql_list(T.VISUAL_NOUNS)}) OR len(list_filter({sql_list(T.DOMAIN_TERMS)}, lambda t: contains(g.keyword_text, t) OR contains(t, g.keyword_text))) > 0 THEN groundability WHEN m.c >= 4 THEN 'HIGH' WHEN m.c >= 2.5 THEN 'MEDIUM' ELSE 'LOW' END AS groundability FROM g LEFT JOIN m USING (keyword_text)",
)(
    lambda s: T.classify_keywords(
        phrases(s).select("keyword_text").distinct(),
        s("fx_keywords").select(F.col("keyword_text").alias("word")).distinct().where(F.length("word") % 3 != 0).withColumn("score", 1 + (F.length("word") * 7 % 17) / 4),
    )
)
register("j11_attach_frequency", "SELECT k.video_id, k.keyword_id, count(DISTINCT j.segment_id) AS global_segment_freq FROM fx_keywords k JOIN fx_keywords j USING (video_id, keyword_text) GROUP BY 1, 2")(lambda s: T.attach_frequency(s("fx_keywords")).select("video_id", "keyword_id", "global_segment_freq"))
register("g15_keyword_quality", "WITH g AS (SELECT video_id, segment_id, count(*) AS n FROM fx_keywords GROUP BY 1, 2) SELECT video_id, count(*) AS n_segments, avg(n) AS mean_keywords, median(n) AS median_keywords, min(n) AS min_keywords, max(n) AS max_keywords FROM g GROUP BY 1", "mean_keywords median_keywords")(
    lambda s: tables.keyword_quality(s("fx_keywords"))
)

# --- time joins -------------------------------------------------------------------------------------------------------
POINTS = "(SELECT video_id, word_id, start_time + 3e0 AS t FROM fx_words WHERE start_time IS NOT NULL)"


def points(s):
    return s("fx_words").where("start_time is not null").select("video_id", "word_id", (F.col("start_time") + 3).alias("t"))


register(
    "j1_scene_at",
    f"WITH j AS (SELECT p.*, s.scene_id, row_number() OVER (PARTITION BY p.video_id, p.word_id ORDER BY CASE WHEN p.t BETWEEN s.t_start AND s.t_end THEN 0 ELSE 1 END, CASE WHEN p.t BETWEEN s.t_start AND s.t_end THEN 0 ELSE abs((s.t_start+s.t_end)/2-p.t) END, s.scene_id) AS rn FROM {POINTS} p JOIN fx_scenes s USING (video_id)) SELECT video_id, word_id, scene_id FROM j WHERE rn = 1",
)(lambda s: J.scene_at(points(s), s("fx_scenes"), "t", "word_id").select("video_id", "word_id", "scene_id"))
register("j2_words_in_interval", f"SELECT g.video_id, g.segment_id, count(*) AS n, min(p.word_id) AS first_word, max(p.word_id) AS last_word FROM fx_segments g JOIN {POINTS} p ON p.video_id=g.video_id AND p.t BETWEEN g.start_time-0.3e0 AND g.end_time+0.3e0 GROUP BY 1, 2")(
    lambda s: J.words_in_interval(points(s), s("fx_segments"), 0.3).groupBy("video_id", "segment_id").agg(F.count(F.lit(1)).alias("n"), F.min("word_id").alias("first_word"), F.max("word_id").alias("last_word"))
)
register(
    "j3_nearest_frame",
    f"WITH f AS (SELECT DISTINCT video_id, frame_time FROM fx_ocr), j AS (SELECT p.video_id, p.word_id, f.frame_time, row_number() OVER (PARTITION BY p.video_id, p.word_id ORDER BY abs(f.frame_time-p.t), f.frame_time) AS rn FROM {POINTS} p LEFT JOIN f ON f.video_id=p.video_id AND f.frame_time BETWEEN p.t-1e0 AND p.t+1e0) SELECT video_id, word_id, frame_time FROM j WHERE rn=1",
    "frame_time",
)(lambda s: J.nearest_frame(points(s), s("fx_ocr"), "t", "word_id", 1.0).select("video_id", "word_id", "frame_time"))
register(
    "j4_nearest_segment",
    "WITH j AS (SELECT s.video_id, s.scene_id, g.segment_id, row_number() OVER (PARTITION BY s.video_id, s.scene_id ORDER BY abs((g.start_time+g.end_time)/2-s.t_keyframe), g.segment_id) AS rn FROM fx_scenes s JOIN fx_segments g USING (video_id)) SELECT video_id, scene_id, segment_id FROM j WHERE rn = 1",
)(lambda s: J.nearest_segment(s("fx_scenes"), s("fx_segments"), "t_keyframe", "scene_id").select("video_id", "scene_id", "segment_id"))
register("j5_frames_in_scene", "SELECT s.video_id, s.scene_id, count(*) AS n, count(DISTINCT o.frame_time) AS n_frames FROM fx_scenes s JOIN fx_ocr o ON o.video_id=s.video_id AND o.frame_time BETWEEN s.t_start AND s.t_end GROUP BY 1, 2")(
    lambda s: J.frames_in_scene(s("fx_scenes"), s("fx_ocr")).groupBy("video_id", "scene_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("frame_time").alias("n_frames"))
)
register("j6_overlapping", "SELECT s.video_id, s.scene_id, g.segment_id FROM fx_scenes s JOIN fx_segments g ON g.video_id=s.video_id AND g.start_time < s.t_end AND g.end_time > s.t_start")(
    lambda s: J.overlapping(s("fx_segments"), s("fx_scenes"), ("start_time", "end_time"), ("t_start", "t_end")).select("video_id", "scene_id", "segment_id")
)
register("j6_overlapping_semi", "SELECT video_id, scene_id FROM fx_scenes s WHERE EXISTS (SELECT 1 FROM fx_segments g WHERE g.video_id=s.video_id AND g.start_time < s.t_end AND g.end_time > s.t_start)")(
    lambda s: J.overlapping(s("fx_scenes"), s("fx_segments"), ("t_start", "t_end"), ("start_time", "end_time"), how="left_semi").select("video_id", "scene_id")
)
register("j14_lookup_first", "WITH f AS (SELECT video_id, segment_id, arg_min(keyword_text, keyword_id) AS keyword_text FROM fx_keywords GROUP BY 1, 2) SELECT g.video_id, g.segment_id, f.keyword_text FROM fx_segments g LEFT JOIN f USING (video_id, segment_id)")(
    lambda s: J.lookup_first(s("fx_segments").select("video_id", "segment_id"), s("fx_keywords").select("video_id", "segment_id", "keyword_id", "keyword_text"), ["video_id", "segment_id"], "keyword_text", F.col("keyword_id"))
)
register("j15_unmatched", "SELECT video_id, segment_id FROM fx_segments g ANTI JOIN fx_keywords k USING (video_id, segment_id)")(lambda s: J.without_partner(s("fx_segments").select("video_id", "segment_id"), s("fx_keywords"), ["video_id", "segment_id"]))

# --- scalars ----------------------------------------------------------------------------------------------------------
TOKENS = "list_sort(list_distinct(list_filter(list_transform(string_split_regex(trim({}), '\\s+'), lambda w: regexp_replace(lower(w), '[^a-z0-9]', '', 'g')), lambda w: length(w) >= 3)))"


def with_previous(s):
    """Token sets of every text and of the text with the id before. Both sides read the sets, so they are written once."""
    d = settled(s("documents").select("doc_id", K.token_set(F.col("text")).alias("a")), "token-sets")
    return d.join(d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")


register(
    "f1_f3_token_sets",
    f"WITH s AS (SELECT doc_id, coalesce({TOKENS.format('text')}, []) AS a FROM documents), t AS (SELECT x.doc_id, x.a, y.a AS b FROM s x JOIN s y ON y.doc_id + 1 = x.doc_id), u AS (SELECT *, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS n FROM t) SELECT doc_id, array_to_string(a, ' ') AS tokens, coalesce(i / nullif(n, 0), 0e0) AS similarity, CASE WHEN n = 0 THEN 0e0 ELSE 1 - i / n END AS distance FROM u",
    "similarity distance",
)(lambda s: with_previous(s).select("doc_id", F.array_join("a", " ").alias("tokens"), K.jaccard(F.col("a"), F.col("b")).alias("similarity"), K.jaccard_distance(F.col("a"), F.col("b")).alias("distance")))


def token_pairs(s):
    k = s("fx_keywords").select("video_id", "keyword_id", "keyword_text")
    return k.join(k.select("video_id", (F.col("keyword_id") - 6).alias("keyword_id"), F.col("keyword_text").alias("other")), ["video_id", "keyword_id"])


THREE = "tp AS (SELECT a.video_id, a.keyword_id, a.keyword_text, b.keyword_text AS other, c.keyword_text AS third FROM fx_keywords a JOIN fx_keywords b ON b.video_id=a.video_id AND b.keyword_id=a.keyword_id+6 LEFT JOIN fx_keywords c ON c.video_id=a.video_id AND c.keyword_id=a.keyword_id+12)"
register("f5_indel_ratio", f"WITH {THREE}, d AS (SELECT DISTINCT keyword_text AS a, other AS b FROM tp), r AS (SELECT a, b, {sqltext.ratio('a', 'b')} AS r FROM d) SELECT video_id, keyword_id, keyword_text, other, r AS ratio, r AS ratio_arrow FROM tp JOIN r ON a = keyword_text AND b = other", "ratio ratio_arrow")(
    lambda s: token_pairs(s).withColumns({"ratio": K.indel_ratio(F.col("keyword_text"), F.col("other")), "ratio_arrow": K.indel_ratio_arrow("keyword_text", "other")})
)


def phrase_pairs(s):
    """A keyword with its next one, against the next one with the one after it."""
    third = s("fx_keywords").select("video_id", (F.col("keyword_id") - 12).alias("keyword_id"), F.col("keyword_text").alias("third"))
    p = token_pairs(s).join(third, ["video_id", "keyword_id"], "left")
    return p.select("video_id", "keyword_id", F.concat_ws(" ", "keyword_text", "other").alias("one"), F.concat_ws(" ", "third", "other").alias("two"))


WORDS_OF = "list_sort(list_distinct(string_split({}, ' ')))"
REST = "array_to_string(list_filter({}, lambda w: NOT list_contains({}, w)), ' ')"
register(
    "f7_token_set_ratio",
    f"""WITH {THREE}, p AS (SELECT video_id, keyword_id, keyword_text || ' ' || other AS one, concat_ws(' ', third, other) AS two FROM tp), d AS (SELECT DISTINCT one, two, {WORDS_OF.format('one')} AS x, {WORDS_OF.format('two')} AS y FROM p),
e AS (SELECT one, two, array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' ') AS common, {REST.format('x', 'y')} AS l, {REST.format('y', 'x')} AS r FROM d), f AS (SELECT *, trim(common || ' ' || l) AS ol, trim(common || ' ' || r) AS o2 FROM e),
g AS (SELECT one, two, CASE WHEN contains(one, two) OR contains(two, one) OR (common <> '' AND (l = '' OR r = '')) THEN 100e0 ELSE greatest(100*({sqltext.ratio('ol', 'o2')}), CASE WHEN common = '' THEN 0e0 ELSE 100*({sqltext.ratio('common', 'ol')}) END, CASE WHEN common = '' THEN 0e0 ELSE 100*({sqltext.ratio('common', 'o2')}) END) END AS ratio FROM f)
SELECT video_id, keyword_id, one, two, ratio FROM p JOIN g USING (one, two)""",
    "ratio",
)(lambda s: phrase_pairs(s).withColumn("ratio", K.token_set_ratio("one", "two")))

# --- sources ----------------------------------------------------------------------------------------------------------
#: A span between brackets of a text can fail to be JSON.
register(
    "s7_parse_rating_json",
    """WITH x AS (SELECT doc_id, regexp_extract(response, '(?s)\\[.*\\]', 0) AS j FROM fx_llm), r AS (SELECT doc_id, CASE WHEN json_valid(j) THEN j ELSE '' END AS j FROM x) SELECT doc_id, try_cast(json_extract_string(nullif(j, ''), '$[0].segment_id') AS BIGINT) AS segment_id, CASE WHEN j = '' THEN NULL ELSE least(greatest(coalesce(try_cast(json_extract_string(nullif(j, ''), '$[0].importance') AS INT), 3), 1), 5) END AS importance, CASE WHEN j <> '' THEN json_extract_string(nullif(j, ''), '$[0].reason') END AS reason, j <> '' AS parsed FROM r""",
)(lambda s: tables.rating_rows(s("fx_llm")))


def strip_sql(x: str, marks: str = tables.SPACE) -> str:
    marks = marks.replace("'", "''")
    return f"regexp_replace({x}, '\\A[{marks}]+|[{marks}]+\\z', '', 'g')"


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


#: Every text as a model's answer: one in three as a JSON list of its words with prose around it, one as a list that is not
#: JSON, the others as they are.
register(
    "s8_parse_concepts",
    f"""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Sure, here it is: ' || to_json(string_split(text, ' ')) || ' - done' WHEN 1 THEN '* ["' || text || '"], ' || text ELSE text END AS response FROM documents),
i AS (SELECT *, regexp_extract(response, '(?s)\\[.*\\]') AS j FROM r),
c AS (SELECT doc_id, CASE WHEN j <> '' AND json_valid(j) THEN list_filter(list_transform(json_extract_string(j, '$[*]'), lambda x: lower({strip_sql("coalesce(x, 'none')")})), lambda x: x <> '')
  ELSE list_transform(list_filter(list_transform(string_split_regex(response, '[\n,]'), lambda x: {strip_sql(strip_sql(strip_sql('x'), tables.BULLETS))}), lambda x: length(x) > 1), lambda x: lower(x)) END AS c FROM i)
SELECT doc_id, unnest(c) AS concept FROM c""",
)(
    lambda s: s("documents").select(
        "doc_id",
        F.explode(
            tables.parse_concepts(
                F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Sure, here it is: "), F.to_json(F.split("text", " ")), F.lit(" - done")))
                .when(F.col("doc_id") % 3 == 1, F.concat(F.lit('* ["'), "text", F.lit('"], '), "text"))
                .otherwise(F.col("text"))
            )
        ).alias("concept"),
    )
)
#: Every text as a model's description, most of them with an opening in front.
DESCRIBED = """CASE doc_id % 9 WHEN 0 THEN concat('Here are the key terms: ', text) WHEN 1 THEN concat('  This frame shows what is said there: the instructional content shows: ', text) WHEN 2 THEN concat(text, ' I cannot read more.')
 WHEN 3 THEN concat('"The image shows ', text, '"') WHEN 4 THEN concat('non-content ', text) WHEN 5 THEN 'A channel logo and a subscribe button' WHEN 6 THEN concat('In this frame, are ', text) WHEN 7 THEN concat('- Key terms: - stacks') ELSE text END"""


def opening_sql() -> str:
    rest = lambda x: strip_sql(f"substr(r, strpos(r, '{x}') + {len(x)})")
    cases = " ".join(f"WHEN strpos(r, '{x}') BETWEEN 1 AND {tables.NEAR} THEN CASE WHEN length({rest(x)}) > {tables.LEAST} THEN {rest(x)} ELSE acc END" for x in tables.SEPARATORS)
    return f"list_transform([strpos(lower(acc), p)], lambda a: CASE WHEN a = 0 THEN acc ELSE list_transform([substr(acc, a + length(p))], lambda r: CASE {cases} ELSE acc END)[1] END)[1]"


def starter_sql() -> str:
    rest, marks = "substr(acc, length(p) + 1)", "\"'.: -"
    cases = " ".join(f"WHEN starts_with(lower({rest}), '{v}') THEN {strip_sql(f'substr({rest}, {len(v) + 1})', marks)}" for v in tables.VERBS)
    return f"CASE WHEN starts_with(lower(acc), p) THEN CASE {cases} ELSE acc END ELSE acc END"


QUOTES = "\"'"
register(
    "s9_clean_description",
    f"""WITH d AS (SELECT doc_id, {strip_sql('t')} AS x FROM (SELECT doc_id, {DESCRIBED} AS t FROM documents)),
o AS (SELECT *, list_reduce(list_prepend(x, {quoted(tables.OPENINGS)}), lambda acc, p: {opening_sql()}) AS y FROM d),
s AS (SELECT *, list_reduce(list_prepend({strip_sql('y', QUOTES)}, {quoted(tables.STARTERS)}), lambda acc, p: {starter_sql()}) AS z FROM o),
l AS (SELECT *, list_filter(list_transform(string_split(z, chr(10)), lambda v: {strip_sql('v')}), lambda v: length(v) > 5 AND length(v) < 150) AS ls FROM s),
u AS (SELECT *, CASE WHEN length(z) > {tables.LONG} AND len(ls) > 0 THEN array_to_string(list_transform(ls, lambda v: {strip_sql(strip_sql('v', '•*-'))})[1:{tables.LINES}], '; ') ELSE z END AS w FROM l)
SELECT doc_id, CASE WHEN contains(replace(upper(x), 'NON-CONTENT', 'NON_CONTENT'), 'NON_CONTENT') OR len(list_filter({quoted(tables.REFUSALS)}, lambda v: contains(lower(x), v))) > 0 OR (length(x) < {tables.SHORT} AND len(list_filter({quoted(tables.SHORT_ONLY)}, lambda v: contains(lower(x), v))) > 0) THEN 'NON_CONTENT' WHEN w = '' THEN x ELSE w END AS text FROM u""",
)(lambda s: s("documents").select("doc_id", tables.clean_description(F.expr(DESCRIBED)).alias("text")))
register("s6_discover_variants", "SELECT substring(p, 1, 2) AS set_name, CAST(substring(p, 3, 1) AS INT) AS delay_level, p || '.mp4' AS path FROM (SELECT DISTINCT set_name || delay_level AS p FROM fx_variants)")(
    lambda s: tables.discover_variants(s("fx_variants").select(F.concat("set_name", F.col("delay_level").cast("string"), F.lit(".mp4")).alias("path")).distinct(), r"^(.*[A-Za-z][0-9]?)([0-9])\.mp4$")
)
register("s5_share_transcript", "SELECT v.video_id, w.word_id, w.word FROM (SELECT DISTINCT video_id FROM fx_variants) v JOIN fx_words w ON w.video_id = 'c1'")(
    lambda s: tables.share_transcript(s("fx_words").select("video_id", "word_id", "word"), "c1", s("fx_variants").select("video_id").distinct())
)
