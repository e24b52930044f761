"""Style, dialogue and fingerprint measures, their rules, and drift over a book."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import prose as N
from ..functions import text as T


def _chars(text: Column) -> Column:
    return T.count(text, V.CJK_STYLE)


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern if group else f"({pattern})"), 1)


def _lengths(parts: Column, least: int) -> Column:
    return F.filter(F.transform(parts, _chars), lambda n: n >= least)


def _sentence_lengths(text: Column | str, least: int = 2) -> Column:
    """CJK characters of each sentence that has so many (of V.STYLE_SENTENCE, whose pieces end where its marks stand)."""
    return F.filter(T.run_lengths(text, V.CJK_STYLE[1:-1], V.SENTENCE_MARKS), lambda n: n >= least)


def _clause_lengths(text: Column | str, least: int) -> Column:
    return F.filter(T.run_lengths(text, V.CJK_STYLE[1:-1], V.CLAUSE_MARKS), lambda n: n >= least)


def _double(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def measured(chapters: DataFrame, *keep: str, through: tuple[str, str] | None = None) -> DataFrame:
    """keep, cjk, checked and the 22 style measures (null where a text is too short to be measured).

    through: letters of the texts and what each is taken for, as of `translate(text, *through)`.
    """
    s = chapters.select(*keep, N.measures("text", through).alias("measures"))
    return s.select(*keep, "measures.cjk", "measures.checked", *[F.get("measures.style", F.lit(i)).alias(k) for i, k in enumerate(N.STYLE)])


def dialogue(chapters: DataFrame, *keep: str) -> DataFrame:
    """keep, dialogue_checked and the 19 dialogue measures (null where there is too little dialogue)."""
    text = F.col("text")
    s = chapters.select(*dict.fromkeys((*keep, "text")), _chars(text).alias("cjk"), T.paragraphs("text").alias("paras"))
    s = s.withColumn("quotes", F.transform(F.filter(_found(text, V.QUOTED, 1), lambda q: _chars(q) >= 1), T.stripped))
    s = s.withColumn("qlen", _double(F.transform("quotes", _chars)))
    s = s.withColumn("said", F.aggregate("qlen", F.lit(0.0), lambda a, n: a + n)).withColumn("blob", F.array_join("quotes", "\n"))
    s = s.withColumn("narration", _double(_sentence_lengths(F.regexp_replace(text, V.QUOTED, ""))))
    s = s.withColumn("qparas", F.filter("paras", lambda p: p.rlike(V.QUOTED)))
    least = V.DIALOGUE_MINIMA
    ok = (F.size("paras") >= least["paragraphs"]) & (F.size("quotes") >= least["quotes"]) & (F.col("cjk") >= least["chars"]) & (F.col("said") >= least["quoted"])
    quotes, qlen = F.col("quotes"), F.col("qlen")
    values = {
        "对白条数每千字": F.size(quotes) / F.col("cjk") * 1000,
        "对白句均字": T.mean(qlen),
        "对白分句均": T.mean(F.transform(quotes, lambda q: F.size(_clause_lengths(q, 1)).cast("double"))),
        "对白句长CV": T.deviation(qlen) / T.mean(qlen),
        "对白极短条占比": T.share(qlen, lambda n: n <= 3),
        "对白短条占比": T.share(qlen, lambda n: n <= 6),
        "对白完整句占比": T.share(quotes, lambda q: q.endswith("。")),
        "对白未收尾占比": T.share(quotes, lambda q: ~q.rlike(V.DIALOGUE_TAIL)),
        "对白问号占比": T.share(quotes, lambda q: q.rlike("[？?]")),
        "对白省略号占比": T.share(quotes, lambda q: q.rlike(V.DENSITIES["省略号密度"])),
        "对白破折号占比": T.share(quotes, lambda q: q.rlike(V.DENSITIES["破折号密度"])),
        **{k: T.count("blob", p) / F.col("said") * 1000 for k, p in V.DIALOGUE_DENSITIES.items()},
        "对白叙述句长比": F.when(F.size("narration") > 0, T.mean(qlen) / T.mean(F.col("narration"))).otherwise(0.0),
        "对白字占比": F.col("said") / F.col("cjk"),
        "引号句未带说语占比": T.share(F.col("qparas"), lambda p: ~F.regexp_replace(p, V.QUOTED, "").rlike(V.DIALOGUE_SAY)),
    }
    return s.select(*keep, ok.alias("dialogue_checked"), *[F.when(ok, v).alias(k) for k, v in values.items()])


def rule_table(spark, rules: dict | None = None) -> DataFrame:
    """metric, place, dir, bound, limit, prompt: the rules as a small table (its size is that of the rule list)."""
    rules = rules or V.STYLE_RULES | V.DIALOGUE_RULES
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(i).alias("place"), F.lit(d).alias("dir"), F.lit(b).alias("bound"), F.lit(x).alias("limit"), F.lit(p).alias("prompt")) for i, (m, (d, b, x, p)) in enumerate(rules.items())])
    return spark.range(1).select(F.inline(rows))


def baselines(spark) -> DataFrame:
    """block, version, books, chapters, holdout_books, holdout_chapters, ai_chapters, rules (names in order) of both baselines."""
    rows = [(k, *v.values(), list(r)) for (k, v), r in zip(V.BASELINES.items(), (V.STYLE_RULES, V.DIALOGUE_RULES))]
    return spark.createDataFrame(rows, "block string, version string, books long, chapters long, holdout_books long, holdout_chapters long, ai_chapters long, rules array<string>")


def limits(rules: DataFrame, mode: str = "judge") -> DataFrame:
    return rules.select("metric", F.coalesce(F.col("prompt") if mode == "prompt" else F.col("limit"), F.col("limit")).alias("limit"))


def percentile(metric: Column, value: Column) -> Column:
    """Where a value lies among the measured percentiles, between two of them by interpolation."""
    out = F.lit(0.0)
    for name, points in V.PERCENTILES.items():
        at = F.lit(50.0)
        for (x0, p0), (x1, p1) in reversed(list(zip(zip(points, V.PERCENTS), zip(points[1:], V.PERCENTS[1:])))):
            between = F.lit(p0) if x1 <= x0 else F.lit(p0) + (p1 - p0) * (value - x0) / (x1 - x0)
            at = F.when((value >= x0) & (value <= x1), between).otherwise(at)
        at = F.when(value <= points[0], 1.0).when(value >= points[-1], 99.0).otherwise(at)
        out = F.when(metric == name, at).otherwise(out)
    return out


def _metrics(chapters: DataFrame, *keep: str, through: tuple[str, str] | None = None) -> DataFrame:
    """keep, checked, dialogue_checked and every metric that has a rule (null where a chapter is not checked)."""
    s = chapters.select(*keep, N.measures("text", through).alias("measures"))
    style = [F.get("measures.style", F.lit(N.STYLE.index(k))).alias(k) for k in V.STYLE_RULES]
    talk = [F.get("measures.dialogue", F.lit(i)).alias(k) for i, k in enumerate(V.DIALOGUE_RULES)]
    return s.select(*keep, "measures.checked", "measures.dialogue_checked", *style, *talk)


def _values(chapters: DataFrame, *keep: str, through: tuple[str, str] | None = None) -> DataFrame:
    """keep, metric, value of every metric that has a rule (null where a chapter is not checked)."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in V.STYLE_RULES | V.DIALOGUE_RULES])
    return _metrics(chapters, *keep, through=through).select(*keep, F.explode(each).alias("m")).select(*keep, "m.*")


def judged(chapters: DataFrame, *keep: str, through: tuple[str, str] | None = None) -> DataFrame:
    """metric, place, mode, limit, judged, beyond: how many chapters each limit of both modes judges and how many lie beyond it."""
    rules = rule_table(chapters.sparkSession)
    both = reduce(DataFrame.unionByName, [rules.join(limits(rules, mode).withColumnRenamed("limit", "used"), "metric").select("metric", "place", "dir", F.lit(mode).alias("mode"), F.col("used").alias("limit")) for mode in ("judge", "prompt")])
    over = F.when(F.col("dir") == "hi", F.col("value") > F.col("limit")).otherwise(F.col("value") < F.col("limit"))
    # The rules are a handful of rows; a rule that no chapter is judged by keeps its row.
    counted = _values(chapters, *keep, through=through).join(F.broadcast(both), "metric").groupBy("metric", "mode").agg(F.count("value").alias("judged"), F.count_if(over).alias("beyond"))
    some = both.join(counted, ["metric", "mode"], "left")
    return some.select("metric", "place", "mode", "limit", F.coalesce("judged", F.lit(0)).alias("judged"), F.coalesce("beyond", F.lit(0)).alias("beyond"))


def against_baselines(chapters: DataFrame, *keep: str, through: tuple[str, str] | None = None) -> DataFrame:
    """block, version, chapters, judged, beyond, share: what of a corpus lies beyond the limits that each baseline gave."""
    b = baselines(chapters.sparkSession).select("block", "version", "chapters", F.explode("rules").alias("metric"))
    found = b.join(judged(chapters, *keep, through=through).filter("mode = 'judge'"), "metric").groupBy("block", "version", "chapters").agg(F.sum("judged").alias("judged"), F.sum("beyond").alias("beyond"))
    return found.withColumn("share", F.when(F.col("judged") > 0, F.col("beyond") / F.col("judged")).otherwise(0.0))


def _beyond(rows: DataFrame) -> DataFrame:
    over = F.when(F.col("dir") == "hi", F.col("value") > F.col("limit")).otherwise(F.col("value") < F.col("limit"))
    return rows.join(F.broadcast(rule_table(rows.sparkSession)), "metric").filter(over)


def findings(chapters: DataFrame, *keep: str) -> DataFrame:
    """keep, metric, value, limit, bound, dir, percentile, rank: measures beyond their rule's limit, worst first.

    Both sets of measures are made in one projection of the text; the rules are unpivoted with them.
    """
    found = _beyond(_values(chapters, *keep))
    order = W.partitionBy(*keep).orderBy(F.col("dir") == "lo", F.desc(F.abs(F.bround("value", 4) - F.col("limit"))), "place")
    return found.select(*keep, "metric", F.bround("value", 4).alias("value"), "limit", "bound", "dir", percentile(F.col("metric"), F.col("value")).alias("percentile"), F.row_number().over(order).alias("rank"))


def evidence(metric: Column, text: Column) -> Column:
    """The piece of a chapter that shows a finding of the metric (empty if none does)."""
    paras, quotes = T.paragraphs(text), F.transform(_found(text, V.QUOTED, 1), T.stripped)
    several = lambda n: F.filter(paras, lambda p: F.size(_sentence_lengths(p)) >= n)
    first = lambda found, most: F.coalesce(F.left(F.get(found, F.lit(0)), F.lit(most)), F.lit(""))
    having = lambda pattern: first(F.filter(paras, lambda p: p.rlike(pattern)), 60)
    said = lambda pattern: F.coalesce(F.left(F.concat(F.lit("「"), F.get(F.filter(quotes, lambda q: q.rlike(pattern)), F.lit(0)), F.lit("」")), F.lit(60)), F.lit(""))
    longest = F.array_max(F.transform(several(2), lambda p, i: F.struct(_chars(p).alias("n"), (-i).alias("i"), p.alias("p"))))
    clauses = F.filter(F.split(text, V.CLAUSE_END), lambda c: _chars(c).between(2, 4))
    return (
        F.when(metric == "对白破折号占比", said(V.DENSITIES["破折号密度"]))
        .when(metric == "对白第二人称密度", said(V.DIALOGUE_DENSITIES["对白第二人称密度"]))
        .when(metric == "对白条数每千字", F.format_string("（全章引号台词 %d 条）", F.size(quotes)))
        .when(metric.isin("破折号密度", "身体外化密度"), F.when(metric == "破折号密度", having(V.DENSITIES["破折号密度"])).otherwise(having(V.DENSITIES["身体外化密度"])))
        .when(metric == "段均句数", first(several(3), 60))
        .when(metric == "段p90字", F.when(longest.isNull(), "（整章没有一个两句话以上的段落，长段被全部删掉）").otherwise(F.format_string("（最长多句段只有 %d 字）%s", longest["n"], F.left(longest["p"], F.lit(50)))))
        .when(metric == "单句段占比", F.lit("（整章多数段落是多句连排，没有用空行分句）"))
        .when(metric == "分句均字", F.left(T.stripped(F.coalesce(F.get(clauses, F.lit(0)), F.lit(""))), F.lit(40)))
        .otherwise("")
    )


def shows(chapters: DataFrame, *keep: str, through: tuple[str, str] | None = None) -> DataFrame:
    """keep, found: (metric, evidence) of every finding of each chapter, made in the text's own row."""
    return chapters.select(*keep, N.evidence("text", through).alias("found"))


def evident(chapters: DataFrame, *keep: str) -> DataFrame:
    """keep, metric, evidence of every finding: nothing is shuffled."""
    return shows(chapters, *keep).select(*keep, F.inline("found"))


def shown(found: DataFrame, chapters: DataFrame, *keep: str) -> DataFrame:
    """The findings with the evidence of each."""
    return found.join(chapters.select(*keep, "text"), list(keep)).withColumn("evidence", evidence(F.col("metric"), F.col("text"))).drop("text")


def scored(chapters: DataFrame, found: DataFrame, *keep: str) -> DataFrame:
    """keep, rules, findings, score of every chapter: the share of the rules it was held against that it breaks (0 if none was)."""
    both = _metrics(chapters, *keep)
    rules = F.col("checked").cast("int") * (len(V.STYLE_RULES) + F.col("dialogue_checked").cast("int") * len(V.DIALOGUE_RULES))
    n = F.coalesce("n", F.lit(0))
    rows = both.select(*keep, rules.alias("rules")).join(found.groupBy(*keep).agg(F.count("*").alias("n")), list(keep), "left")
    return rows.select(*keep, "rules", n.alias("findings"), F.when(F.col("rules") > 0, F.bround(n / F.col("rules"), 4)).otherwise(0.0).alias("score"))


def scores(chapters: DataFrame, *keep: str, through: tuple[str, str] | None = None) -> DataFrame:
    """keep, rules, findings, score of every chapter as `scored` gives them, in one projection of the text: nothing is joined or shuffled."""
    rules = F.col("checked").cast("int") * (len(V.STYLE_RULES) + F.col("dialogue_checked").cast("int") * len(V.DIALOGUE_RULES))
    # Measures are doubles: a missing one is beyond no limit.
    beyond = lambda m, way, limit: F.coalesce((F.col(m) > limit) if way == "hi" else (F.col(m) < limit), F.lit(False)).cast("long")
    n = sum((beyond(m, way, limit) for m, (way, _, limit, _) in (V.STYLE_RULES | V.DIALOGUE_RULES).items()), F.lit(0).cast("long"))
    rows = _metrics(chapters, *keep, through=through).select(*keep, rules.alias("rules"), n.alias("findings"))
    return rows.select(*keep, "rules", "findings", F.when(F.col("rules") > 0, F.bround(F.col("findings") / F.col("rules"), 4)).otherwise(0.0).alias("score"))


def fingerprint(chapters: DataFrame, *keep: str) -> DataFrame:
    """keep, the eight fingerprint values, violations and passed (one violation at most)."""
    text = F.col("text")
    s = chapters.select(*keep, "text", T.paragraphs("text").alias("paras"))
    long_rate = T.share(F.col("paras"), lambda p: T.count(p, "。") > V.PERIODS_PARAGRAPH)
    similes = F.transform("paras", lambda p: T.count(p, V.SIMILE_CHAPTER))
    runs = F.transform(_found(text, V.DE_RUN), lambda r: T.count(r, "的"))
    heads = F.transform("paras", lambda p: F.left(p, F.lit(12)).rlike(V.SCENE_START) | F.left(p, F.lit(60)).rlike(V.TRANSITION))
    s = s.withColumn("similes", similes).withColumn("runs", runs)
    values = {
        "not_x_but_y": T.count(text, V.NOT_X_BUT_Y),
        "em_dash": T.count(text, "——"),
        "period_per_paragraph": F.bround(long_rate, 4),
        "simile_density": F.aggregate("similes", F.lit(0), lambda a, n: a + n),
        "de_repeat": F.coalesce(F.array_max("runs"), F.lit(0)),
        "scene_rotation": F.size(F.filter(heads, lambda x: x)),
        "cjk_chars": T.count(text, V.CJK_WIDE),
        "single_quote": T.count(text, "[‘’']"),
    }
    s = s.select(*keep, *[v.cast("double").alias(k) for k, v in values.items()], long_rate.alias("long_rate"), T.share(F.col("similes"), lambda n: n > 1).alias("dense"))
    x = V.FINGERPRINT_LIMITS
    bad = [
        F.col("not_x_but_y") > x["not_x_but_y"],
        F.col("em_dash") > x["em_dash"],
        F.col("long_rate") > x["period_per_paragraph"],
        (F.col("simile_density") > x["simile_density"]) | (F.col("dense") > V.DENSE_SIMILES),
        F.col("de_repeat") > x["de_repeat"],
        F.col("cjk_chars") < x["cjk_chars"],
    ]
    n = sum((b.cast("int") for b in bad[1:]), bad[0].cast("int"))
    return s.select(*keep, *values, n.alias("violations"), (n <= V.MAX_VIOLATIONS).alias("passed"))


def drift(fingerprints: DataFrame, exempt: str | None = None) -> DataFrame:
    """book, ord, rule, middle: rules whose median over the last five chapters exceeds twice the human 95th percentile.

    History is the chapters at most twelve numbers before that exist; fewer than five values never drift.
    """
    rules = list(V.DRIFT_P95)
    each = fingerprints.select("book", "ord", *([exempt] if exempt else []), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value"), F.lit(V.DRIFT_P95[r]).alias("p95")) for r in rules])).alias("r"))
    each = each.select("book", "ord", *([exempt] if exempt else []), "r.*")
    last = W.partitionBy("book", "rule").orderBy("ord").rowsBetween(-(V.DRIFT_WINDOW - 1), 0)
    held = F.filter(F.collect_list(F.struct("ord", "value")).over(last), lambda x: x["ord"] >= F.col("ord") - 12)
    w = each.withColumn("w", F.array_sort(F.transform(held, lambda x: x["value"])))
    middle = F.get("w", F.lit(V.DRIFT_WINDOW // 2))
    found = w.filter((F.size("w") >= V.DRIFT_WINDOW) & (middle > F.col("p95") * V.DRIFT_RATIO))
    return (found.filter(~F.col(exempt)) if exempt else found).select("book", "ord", "rule", middle.alias("middle"))
