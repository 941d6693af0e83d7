"""Words to segments and keywords: timestamp checks, segmentation, n-gram candidates, merging, first mentions."""

from __future__ import annotations

import itertools
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import normalize_word
from ..sources.shared import large, settled
from ..sources.tables import let
from .timejoin import words_in_interval

# Word lists of the keyword rules.
VISUAL_NOUNS = """diagram chart graph table code formula equation image figure screenshot slide animation network layer matrix plot histogram bar pie scatter flowchart tree map photo picture video display screen interface button menu icon arrow box""".split()
ABSTRACT_WORDS = """understanding importance approach however therefore relationship concept idea theory principle method way thing stuff aspect factor issue problem solution result effect impact influence role""".split()
VAGUE_NOUNS = """one order point time part bit lot kind sort case example step move try start end turn need use work look set run call let hold think imagine mean mind sense deal change chance focus process quality option choice terms basis essence manner nature respect regard behalf""".split()
DOMAIN_TERMS = [
    "hill climbing", "simulated annealing", "local search", "gradient descent", "genetic algorithm", "neural network", "decision tree", "random forest", "backpropagation", "clustering", "classification", "regression",
    "stack", "queue", "linked list", "binary tree", "hash table", "heap",
    "function", "objective function", "cost function", "fitness function", "maximum", "minimum", "optimum", "global maximum", "local maximum", "plateau", "ridge", "valley", "landscape", "search space", "temperature", "cooling", "convergence",
    "traveling salesman", "knapsack", "scheduling", "routing",
    "state", "neighbor", "path", "node", "edge", "weight",
]
STOP_WORDS = """the a an is are was were be been being have has had do does did will would shall should may might can could of in to for with on at by from as into about between through after before during and but or nor not so yet both either neither this that these those it its we you he she they i me my our your his her their them also just like going really actually basically right well okay now here there then very much many some any all each every more most""".split()
INSTRUCTIONAL_VERBS = """define describe identify list name recall recognize explain summarize interpret classify compare contrast apply calculate compute demonstrate solve use analyze differentiate distinguish examine investigate evaluate assess justify argue critique create design develop formulate construct notice observe consider note look see show derive prove verify check substitute simplify""".split()
DISCOURSE_PATTERNS = [
    r"\bas you can see\b", r"\blook(?:ing)? at\b", r"\bnotice (?:that|how|the)\b", r"\bthis is important\b", r"\bthe key (?:idea|point|concept|thing)\b", r"\bpay attention to\b", r"\bas (?:shown|illustrated|depicted)\b",
    r"\bin (?:this|the) (?:diagram|figure|graph|chart|table|slide|image)\b", r"\bon (?:the|this) (?:screen|slide|board)\b", r"\bhere (?:we|you|I) (?:can )see\b", r"\blet me show\b", r"\bif you look\b", r"\bwhat (?:we|you) see\b", r"\bthe formula (?:is|shows|says)\b",
]
CONJUNCTIONS = "and but or so because however although while when then".split()


def with_midpoint(rows: DataFrame) -> DataFrame:
    return rows.withColumn("t_mid", (F.col("start_time") + F.col("end_time")) / 2)


def flag_bad_timestamps(words: DataFrame, shortest: float = 0.05, longest: float = 2.0, gap: float = 3.0) -> DataFrame:
    """timestamp_reliable and the first rule that fails."""
    w = Window.partitionBy("video_id").orderBy("word_id")
    s, e = F.col("start_time"), F.col("end_time")
    reason = (
        F.when(s.isNull() | e.isNull(), "missing")
        .when((e - s < shortest) | (e - s > longest), "duration")
        .when(s - F.lag("end_time").over(w) > gap, "gap")
        .when(s < F.lag("start_time").over(w), "order")
    )
    return words.withColumn("reason", reason).withColumn("timestamp_reliable", F.col("reason").isNull())


def groundability(keyword: Column) -> Column:
    """HIGH, MEDIUM or LOW by word lists."""
    k = F.lower(F.trim(keyword))
    words = F.split(k, r"\s+")
    array = lambda xs: F.array(*map(F.lit, xs))
    domain = F.exists(array(DOMAIN_TERMS), lambda t: F.contains(k, t) | F.contains(t, k))
    empty = array([*VAGUE_NOUNS, *ABSTRACT_WORDS, *STOP_WORDS])
    content = F.exists(words, lambda w: ~F.array_contains(empty, w) & (F.length(w) >= 3))
    single = F.size(words) == 1
    return (
        F.when(F.arrays_overlap(words, array(VISUAL_NOUNS)), "HIGH")
        .when(domain, "MEDIUM")
        .when(single & k.isin(*ABSTRACT_WORDS, *VAGUE_NOUNS), "LOW")
        .when(single & (F.length(k) <= 4), "LOW")
        .when(single, "MEDIUM")
        .when(content, "MEDIUM")
        .otherwise("LOW")
    )


def classify_keywords(keywords: DataFrame, concreteness: DataFrame | None = None) -> DataFrame:
    """+ groundability. With a concreteness table (word, score) its mean decides where no list does."""
    by_list = keywords.withColumn("groundability", groundability(F.col("keyword_text")))
    if concreteness is None:
        return by_list
    distinct = keywords.select("keyword_text").distinct()
    tokens = distinct.withColumn("word", F.explode(F.split(F.lower(F.trim("keyword_text")), r"\s+")))
    mean = tokens.join(concreteness, "word").groupBy("keyword_text").agg(F.avg("score").alias("c_"))
    k = F.lower(F.trim("keyword_text"))
    listed = F.arrays_overlap(F.split(k, r"\s+"), F.array(*map(F.lit, VISUAL_NOUNS))) | F.exists(F.array(*map(F.lit, DOMAIN_TERMS)), lambda t: F.contains(k, t) | F.contains(t, k))
    rated = F.when(F.col("c_") >= 4, "HIGH").when(F.col("c_") >= 2.5, "MEDIUM").otherwise("LOW")
    return by_list.join(mean, "keyword_text", "left").withColumn("groundability", F.when(~listed & F.col("c_").isNotNull(), rated).otherwise(F.col("groundability"))).drop("c_")


def in_segments(words: DataFrame, group: str) -> DataFrame:
    """Words with a group number -> segments: text, start, end, n_words."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("word_id", "word"))), lambda x: x["word"])
    return words.groupBy("video_id", group).agg(F.array_join(parts, " ").alias("text"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count(F.lit(1)).alias("n_words"))


def sentence_numbers(words: DataFrame) -> DataFrame:
    """+ segment_id: a word that ends in . ! or ? closes its segment."""
    w = Window.partitionBy("video_id").orderBy("word_id").rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("segment_id", F.coalesce(F.sum(F.col("word").rlike("[.!?]$").cast("long")).over(w), F.lit(0)))


def resegment_sentences(words: DataFrame) -> DataFrame:
    return in_segments(sentence_numbers(words), "segment_id")


def merge_short_segments(segments: DataFrame, least: int = 4) -> DataFrame:
    """A segment under so many words joins the one before it; the first never does."""
    w = Window.partitionBy("video_id").orderBy("segment_id")
    opens = ((F.col("n_words") >= least) | (F.row_number().over(w) == 1)).cast("long")
    rows = segments.withColumn("opens_", opens).withColumn("new_", F.sum("opens_").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "text"))), lambda x: x["text"]), " ")
    out = rows.groupBy("video_id", "new_").agg(text.alias("text"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("n_words").alias("n_words"))
    return out.withColumnRenamed("new_", "segment_id")


def cut_points(words: list[str], most: int) -> list[int]:
    """Where a long segment is cut: at the clause boundary nearest to the middle, else in the middle, again and again."""
    cuts, todo = [], [(0, len(words))]
    while todo:
        low, high = todo.pop()
        if high - low <= most:
            continue
        middle = (low + high) // 2
        ends = [i for i in range(low + 1, high) if words[i - 1].endswith((",", ";")) or words[i].lower() in CONJUNCTIONS]
        at = min(ends, key=lambda i: (abs(i - middle), i), default=middle)
        cuts.append(at)
        todo += [(low, at), (at, high)]
    return sorted(cuts)


def split_long_segments(words: DataFrame, most: int = 40) -> DataFrame:
    """words with segment_id -> segments of at most so many words. Only long segments leave the JVM, one row each."""
    per = words.groupBy("video_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("word_id", "word", "start_time", "end_time"))).alias("w"))

    @F.pandas_udf("array<int>")
    def cuts(texts: pd.Series) -> pd.Series:
        return pd.Series([cut_points(list(t), most) for t in texts])

    long = F.size("w") > most
    far = per.where(long).withColumn("cuts", cuts(F.transform("w", lambda x: x["word"])))
    near = per.where(~long).withColumn("cuts", F.array().cast("array<int>"))
    rows = near.unionByName(far).select("video_id", "segment_id", "cuts", F.posexplode("w").alias("pos", "x")).select("video_id", "segment_id", "cuts", "pos", "x.*")
    rows = rows.withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("pos")))).drop("cuts", "pos")
    parts = in_segments(rows.withColumn("g_", F.struct("segment_id", "part")), "g_")
    order = Window.partitionBy("video_id").orderBy("g_")
    return parts.withColumn("segment_id", (F.row_number().over(order) - 1).cast("long")).drop("g_")


def word_windows(words: DataFrame, k: int = 3) -> DataFrame:
    """Sliding windows of k words inside a segment with their mean middle; one shorter window if there are fewer."""
    w = Window.partitionBy("video_id", "segment_id").orderBy("word_id")
    frame = w.rowsBetween(0, k - 1)
    rows = words.withColumn("text", F.array_join(F.collect_list("word").over(frame), " ")).withColumn("t", F.avg((F.col("start_time") + F.col("end_time")) / 2).over(frame))
    rows = rows.withColumn("n_", F.count(F.lit(1)).over(frame)).withColumn("first_", F.row_number().over(w) == 1)
    return rows.where((F.col("n_") == k) | F.col("first_")).select("video_id", "segment_id", "word_id", "text", "t")


def keyword_candidates(segments: DataFrame, most: int = 3, top: int = 5, least: int = 3) -> DataFrame:
    """n-grams without stop words, by tf-idf over the segments of a recording; the best few per segment. Stop words become
    null once a word, and an n-gram with a null is null; candidates are sent by recording and text, then by segment."""
    seg = settled(segments.select("video_id", "segment_id", "text"), "candidate-segments")
    words = F.filter(F.transform(F.split(F.col("text"), r"\s+"), normalize_word), lambda x: x != "")
    n = seg.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    w = seg.join(large(n), "video_id").select("video_id", "segment_id", "n", F.transform(words, lambda x: F.when(~x.isin(STOP_WORDS), x)).alias("w"))
    gram = lambda k: lambda x, i: F.concat(x, *[y for j in range(1, k) for y in (F.lit(" "), F.get("w", i + j))])
    grams = F.flatten(F.array(*[F.transform("w", gram(k)) for k in range(1, most + 1)]))
    g = w.select("video_id", "segment_id", "n", F.explode(F.filter(grams, lambda x: F.length(x) >= least)).alias("keyword_text"))
    tf = g.groupBy("video_id", "segment_id", "n", "keyword_text").agg(F.count(F.lit(1)).alias("tf")).repartition("video_id", "keyword_text")  # else a recording is one task's
    df = F.count(F.lit(1)).over(Window.partitionBy("video_id", "keyword_text"))
    rows = tf.withColumn("score", F.col("tf") * F.log(F.col("n") / df))
    order = Window.partitionBy("video_id", "segment_id").orderBy(F.round("score", 9).desc(), "keyword_text")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("video_id", "segment_id", "keyword_text", "score", "rank")


def merge_keywords(keywords: DataFrame, least: int = 3) -> DataFrame:
    """Distinct cleaned keywords of a segment, without proper parts of longer ones and without phrases that share more
    than half of their words with one of more words. Keywords of one segment are few; pairs meet inside it."""
    k = F.lower(F.trim("keyword_text"))
    clean = keywords.select("video_id", "segment_id", k.alias("keyword_text")).where((F.length("keyword_text") >= least) & ~F.col("keyword_text").isin(STOP_WORDS)).distinct()

    def drop(rows: DataFrame, worse: Column) -> DataFrame:
        return rows.alias("a").join(rows.alias("b"), (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.segment_id") == F.col("b.segment_id")) & worse, "left_anti")

    once = drop(clean, F.contains("b.keyword_text", "a.keyword_text") & (F.length("a.keyword_text") < F.length("b.keyword_text")))
    words = lambda c: F.array_distinct(F.split(F.col(c), r"\s+"))
    a, b = words("a.keyword_text"), words("b.keyword_text")
    return drop(once, (F.size(a) < F.size(b)) & (F.size(F.array_intersect(a, b)) > 0.5 * F.size(a)))


def assign_t_narr(keywords: DataFrame, words: DataFrame, segments: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Time of each keyword: a word of its segment equal to its first word, else equal when normalised (3 or more
    characters), else one that holds the other (4 or more), else the segment's middle. The earliest word wins and lends its
    timestamp_reliable; words without that column, and middles, count as reliable."""
    k = keywords.join(large(segments.select("video_id", "segment_id", "start_time", "end_time")), ["video_id", "segment_id"])
    first = F.split(F.lower(F.trim("keyword_text")), r"\s+")[0]
    w = words.where("start_time is not null").select("video_id", "word_id", F.lower("word").alias("w_"), F.col("start_time").alias("t"), (F.col("timestamp_reliable") if "timestamp_reliable" in words.columns else F.lit(True)).alias("timestamp_reliable"))
    spans = segments.select("video_id", "segment_id", "start_time", "end_time")
    met = words_in_interval(w, spans, tolerance).drop("start_time", "end_time")
    pairs = k.select("video_id", "segment_id", "keyword_id", first.alias("f_")).join(large(met), ["video_id", "segment_id"])
    a, b = normalize_word(F.col("f_")), normalize_word(F.col("w_"))
    step = F.when(F.col("w_") == F.col("f_"), 1).when((a == b) & (F.length(a) >= 3), 2).when((F.length(a) >= 4) & (F.contains(a, b) | F.contains(b, a)), 3)
    best = pairs.withColumn("step", step).where("step is not null").groupBy("video_id", "keyword_id").agg(F.min(F.struct("step", "word_id", "t", "timestamp_reliable")).alias("m"))
    out = k.join(large(best), ["video_id", "keyword_id"], "left")
    method = F.when(F.col("m.step") == 1, "exact").when(F.col("m.step") == 2, "normalized").when(F.col("m.step") == 3, "substring").otherwise("segment_midpoint")
    return out.select(*keywords.columns, F.coalesce("m.t", (F.col("start_time") + F.col("end_time")) / 2).alias("t_narr_found"), method.alias("t_narr_method"), F.coalesce("m.timestamp_reliable", F.lit(True)).alias("t_narr_reliable"))


def attach_frequency(keywords: DataFrame) -> DataFrame:
    n = keywords.groupBy("video_id", "keyword_text").agg(F.count_distinct("segment_id").alias("global_segment_freq"))
    return keywords.join(large(n), ["video_id", "keyword_text"], "left")


def first_mention(keywords: DataFrame, window: float = 60.0) -> DataFrame:
    """+ is_first_mention: false if the earliest time of some token set that shares at least half of the smaller of both
    sets lies before this keyword within the window, or if the keyword has no tokens."""
    tokens = F.array_sort(F.array_distinct(F.filter(F.transform(F.split("keyword_text", r"\s+"), normalize_word), lambda x: F.length(x) >= 3)))
    k = settled(keywords.withColumn("set_", tokens), "keyword-sets")  # read three times
    sets = k.where(F.size("set_") > 0).groupBy("video_id", "set_").agg(F.min("t_narr").alias("t0_"))
    mine = k.select("video_id", "keyword_id", "t_narr", "set_").withColumn("tok_", F.explode("set_"))
    other = sets.select("video_id", F.col("set_").alias("s_"), "t0_").withColumn("tok_", F.explode("s_"))
    shared = mine.join(large(other), ["video_id", "tok_"]).where((F.col("t0_") < F.col("t_narr")) & (F.col("t_narr") - F.col("t0_") <= window))
    hit = shared.groupBy("video_id", "keyword_id", "s_").agg(F.count(F.lit(1)).alias("n_"), F.first("set_").alias("set_")).where(F.col("n_") >= 0.5 * F.least(F.size("set_"), F.size("s_")))
    seen = hit.select("video_id", "keyword_id").distinct().withColumn("seen_", F.lit(True))
    return k.join(large(seen), ["video_id", "keyword_id"], "left").withColumn("is_first_mention", (F.size("set_") > 0) & F.col("seen_").isNull()).drop("set_", "seen_")


def vocabulary(words: DataFrame, least: int = 3) -> DataFrame:
    return words.select("video_id", normalize_word(F.col("word")).alias("tok")).where(F.length("tok") >= least).distinct()


def correct_tokens(tokens: DataFrame, vocab: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Adds, for tokens outside the vocabulary, the most similar word if it reaches the threshold; ties to the smallest.
    Tokens and words meet by recording and by length, so a token is compared with words within 30 % of its length."""
    from ..functions.tokens import indel_ratio_arrow, may_reach

    odd = tokens.join(large(vocab), ["video_id", "tok"], "left_anti").select("video_id", "tok").distinct()
    span = F.sequence(F.ceil(F.length("tok") * 0.7).cast("int"), F.floor(F.length("tok") / 0.7).cast("int"))
    left = odd.withColumn("len_", F.explode(span))
    right = vocab.select("video_id", F.col("tok").alias("word"), F.length("tok").alias("len_"))
    pairs = left.join(large(right), ["video_id", "len_"]).where(may_reach(F.col("tok"), F.col("word"), threshold)).withColumn("ratio", indel_ratio_arrow("tok", "word")).where(F.col("ratio") >= threshold)
    best = pairs.groupBy("video_id", "tok").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "word")).alias("b")).select("video_id", "tok", F.col("b.word").alias("word"))
    extra = tokens.join(large(best), ["video_id", "tok"]).drop("tok").withColumnRenamed("word", "tok")
    return tokens.unionByName(extra.select(*tokens.columns)).distinct()


def abbreviation_variants(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """Where a token is a variant (plain or hyphenated) of an all-capital spoken word, both variants are added."""
    w = F.regexp_replace("word", "[^A-Za-z0-9]", "")
    caps = words.select("video_id", w.alias("w")).where((F.length("w") >= 2) & (F.col("w") == F.upper("w")) & F.col("w").rlike("[A-Z]")).distinct()
    both = caps.select("video_id", F.array(F.lower("w"), F.array_join(F.split(F.lower("w"), ""), "-")).alias("v"))
    met = tokens.join(both.withColumn("tok", F.explode("v")), ["video_id", "tok"])
    return tokens.unionByName(met.withColumn("tok", F.explode("v")).select(*tokens.columns)).distinct()


def new_words_per_scene(scenes: DataFrame) -> DataFrame:
    """scenes with words (array): + new_words, those not in the last scene before it that had any."""
    w = Window.partitionBy("video_id").orderBy("scene_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.size("words") > 0, F.col("words")), ignorenulls=True).over(w)
    rows = scenes.withColumn("before_", F.coalesce(before, F.array().cast("array<string>")))
    return rows.withColumn("new_words", F.array_except("words", "before_")).drop("before_")


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions)


def spelled_out(pattern: str) -> list[str]:
    """The texts that a pattern of words and groups of words stands for, without its word borders."""
    parts = re.split(r"\(\?:([^)]*)\)(\??)", pattern.replace(r"\b", ""))
    choices = [[plain] for plain in parts[::3]]
    groups = [[*words.split("|"), *([""] if maybe else [])] for words, maybe in zip(parts[1::3], parts[2::3])]
    return ["".join(x) for x in itertools.product(*[c for pair in itertools.zip_longest(choices, groups, fillvalue=[""]) for c in pair])]


def instructional_verb_score(text: Column) -> Column:
    """Verbs are sought one by one, short ones first, as most texts hold one of them: a pattern tries all at every place."""
    return F.when(let(F.lower(text), lambda x: any_of([F.contains(x, F.lit(v)) for v in sorted(INSTRUCTIONAL_VERBS, key=len)])), 0.5).otherwise(0.0)


def discourse_signal_score(text: Column) -> Column:
    """A pattern, for its word borders, is only tried on texts that hold one of the texts that it stands for."""
    told = lambda x: any_of([any_of([F.contains(x, F.lit(v)) for v in spelled_out(p)]) & x.rlike(p) for p in DISCOURSE_PATTERNS])
    return F.when(let(F.lower(text), told), 1.0).otherwise(0.0)
