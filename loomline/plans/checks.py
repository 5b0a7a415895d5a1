"""Queries over checks, look-ups by time, text helpers and point estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import annotate, backtest, features, grid, match, metrics, regression, resampling, sampling, splits, stats, validate
from ..sources import files, roles
from .evaluation import BT, KEYS, MSE, PAIRED, differences, predictions, traded
from .joins import hac
from .news import PRICED, matches
from .registry import FEATURES, NEWS, PREDICTIONS, PRICE_COLUMNS, R, T, query, rounded, sql, timed
from .series import TABLE, model_table, priced

ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


@query(sql(NEWS, f"SELECT source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(title, '{ENTITY}')) AS with_entities FROM news GROUP BY source"))
def entity_titles(spark, sf_dir):
    """Titles in which HTML entities are left."""
    news = roles.headlines(spark, sf_dir).select("source", "title")
    return news.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("title").rlike(ENTITY)).alias("with_entities"))


@query(sql(PRICED + ", d AS (SELECT CAST(round_even(minutes, 0) AS BIGINT) AS delta, count(*) AS n FROM matched GROUP BY 1)", "SELECT delta, n FROM d ORDER BY n DESC, delta LIMIT 10"))
def commonest_deltas(spark, sf_dir):
    return match.commonest_deltas(matches(spark, sf_dir))


@query(sql(NEWS + ", k AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || CAST(doc_id AS VARCHAR))) AS k FROM news)", "SELECT lang, doc_id FROM k WHERE k <= 5"))
def random_examples(spark, sf_dir):
    """Five random headlines of each language."""
    return sampling.examples(roles.headlines(spark, sf_dir).select("lang", "doc_id"), "lang", "doc_id", 5, 3)


@query(
    sql(
        "m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders), k AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS n FROM m WHERE month >= '1995-01'),"
        " s AS (SELECT month FROM k WHERE i IN (SELECT CAST(round_even(j * (n - 1) / 15.0, 0) AS BIGINT) FROM (SELECT unnest(generate_series(0, 15)) AS j)))",
        "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE day(o_orderdate) BETWEEN 2 AND 27 AND strftime(o_orderdate, '%Y-%m') IN (SELECT month FROM s) GROUP BY 1",
    )
)
def sample_days(spark, sf_dir):
    """Rows of the sampled months, without days at a month's edges."""
    rows = roles.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("published"))
    got = match.sample_rows(rows, match.sample_months(rows, "1995-01"))
    return got.groupBy(times.month_label(F.col("published")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


PAIRED_MODELS = [("Q", "zero", "mean"), ("Q", "zero", "last"), ("Q", "mean", "mean6")]


@query(sql(PREDICTIONS + MSE, "SELECT m.symbol, v.base, v.model, TRUE AS agrees FROM (VALUES ('zero', 'mean'), ('zero', 'last'), ('mean', 'mean6')) v(base, model) JOIN mse m ON m.model = v.model JOIN mse b ON b.symbol = m.symbol AND b.model = v.base"))
def mse_cross_check(spark, sf_dir):
    """The change of the squared error by two ways: from mean errors, and from the mean loss difference."""
    by_mean = metrics.pair_change(predictions(spark, sf_dir), PAIRED_MODELS)
    by_loss = stats.effect_bounds(differences(spark, sf_dir))
    return validate.cross_check(by_mean, by_loss, ["symbol", "base", "model"], "change_pct", 1e-6).select("symbol", "base", "model", "agrees")


LANGUAGE_PAIRS = """pairs AS (SELECT source, source || ':' || CASE WHEN doc_id % 2 = 0 THEN 'P' ELSE 'P_EN' END AS base, source || ':' || CASE doc_id % 3 WHEN 0 THEN 'P_EN' WHEN 1 THEN 'P_RU' ELSE 'P_EN_RU' END AS alternative FROM documents)"""


@query(sql(LANGUAGE_PAIRS, "SELECT base, alternative, CASE WHEN alternative LIKE '%:P!_EN!_RU' ESCAPE '!' THEN CASE WHEN base LIKE '%:P!_EN' ESCAPE '!' THEN 'ru' ELSE 'both' END WHEN alternative LIKE '%:P!_EN' ESCAPE '!' THEN 'en' ELSE 'ru' END AS language, count(*) AS n FROM pairs GROUP BY base, alternative"))
def relevant_language(spark, sf_dir):
    doc = F.col("doc_id")
    base = F.concat("source", F.when(doc % 2 == 0, ":P").otherwise(":P_EN"))
    alternative = F.concat("source", F.when(doc % 3 == 0, ":P_EN").when(doc % 3 == 1, ":P_RU").otherwise(":P_EN_RU"))
    rows = roles.table(spark, sf_dir, "documents").select(base.alias("base"), alternative.alias("alternative"))
    per = rows.groupBy("base", "alternative").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("language", stats.relevant_language(F.col("base"), F.col("alternative")))


@query(sql(FEATURES, f"SELECT a.symbol, {T('a.open_time', 'open_time')}, {R('coalesce(b.ret_lag1, 0.0)', 'a_day_before')} FROM price a LEFT JOIN price b ON b.symbol = a.symbol AND b.open_time = a.open_time - INTERVAL 24 HOUR"))
def day_before_return(spark, sf_dir):
    """Each hour's return a day before, by the clock."""
    rows = priced(spark, sf_dir).select("symbol", "open_time", "ret_lag1")
    got = features.at_earlier_time(rows.select("symbol", "open_time"), rows, "ret_lag1", 24).withColumnRenamed("ret_lag1_at", "a_day_before")
    return timed(rounded(got, "a_day_before"), "open_time")


@query(sql(PREDICTIONS, f"SELECT symbol, model, {T('open_time', 'open_time')}, {R('y_true', 'y_true')}, {R('y_pred * 1.1', 'y_pred')} FROM pred"))
def seed_average(spark, sf_dir):
    """Means over three seeds, whose forecasts differ by a factor."""
    rows = predictions(spark, sf_dir).withColumn("seed", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumn("y_pred", F.col("y_pred") * (1 + F.col("seed") * 0.1))
    return timed(rounded(metrics.seed_average(rows).select("symbol", "model", "open_time", "y_true", "y_pred"), "y_true", "y_pred"), "open_time")


OFFSETS = "o AS (SELECT event_id, ts, (CAST(user_id AS BIGINT) % 53) * 30 - 720 AS minutes FROM events)"


@query(sql(OFFSETS, f"SELECT event_id, {T('ts - INTERVAL 1 MINUTE * minutes', 'utc')}, 'UTC' || CASE WHEN minutes < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(minutes) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(minutes) % 60 AS VARCHAR), 2, '0') AS zone FROM o"))
def offset_clocks(spark, sf_dir):
    """Clock readings of zones from UTC-12 to UTC+14 as UTC."""
    rows = roles.table(spark, sf_dir, "events").select("event_id", roles.as_utc(F.col("ts")).alias("ts"), (F.col("user_id") % 53 * 30 - 720).cast("int").alias("minutes"))
    return timed(rows.select("event_id", times.to_utc(F.col("ts"), F.col("minutes")).alias("utc"), times.offset_label(F.col("minutes")).alias("zone")), "utc")


@query(sql(FEATURES + ", k AS (SELECT symbol, open_time, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS k FROM price)", f"SELECT symbol, count(*) FILTER (WHERE k <= {features.warmup_hours()}) AS warm_up, {T(f'min(open_time) FILTER (WHERE k > {features.warmup_hours()})', 'first_full')} FROM k GROUP BY symbol"))
def warm_up(spark, sf_dir):
    """Hours before the first one with enough history for all news features."""
    from pyspark.sql import Window

    rows = priced(spark, sf_dir).select("symbol", "open_time", F.row_number().over(Window.partitionBy("symbol").orderBy("open_time")).alias("k"))
    full = F.col("k") > features.warmup_hours()
    return timed(rows.groupBy("symbol").agg(F.count_if(~full).alias("warm_up"), F.min(F.when(full, F.col("open_time"))).alias("first_full")), "first_full")


@query(sql("k AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS open_time, event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS k FROM events)", f"SELECT symbol, {T('open_time', 'open_time')}, event_id FROM k WHERE k = 1"))
def candle_dedup(spark, sf_dir):
    """The first of several records of one symbol and hour."""
    rows = roles.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", roles.as_utc(F.col("ts"))).alias("open_time"), "event_id")
    return timed(grid.first_of(rows, ["symbol", "open_time"], [F.col("event_id")]), "open_time")


@query("SELECT role, count(*) AS n FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY role")
def unknown_roles(spark, sf_dir):
    """Roles outside the vocabulary."""
    rows = validate.unknown_labels(roles.table(spark, sf_dir, "conversations").select("role"), "role", ["user", "assistant"])
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n")).filter("role is not null")


@query(
    sql(
        "e AS (SELECT date_trunc('month', max(o_orderdate)) AS e FROM orders), k AS (SELECT unnest(generate_series(0, 7)) AS k), f AS (SELECT 'fold_0' || CAST(k + 1 AS VARCHAR) AS name, e - INTERVAL 1 MONTH * (24 - 3 * k) AS a, e - INTERVAL 1 MONTH * (21 - 3 * k) AS b FROM e, k UNION ALL SELECT 'tuning', e - INTERVAL 30 MONTH, e - INTERVAL 24 MONTH FROM e)",
        f"SELECT name, {T('a - INTERVAL 24 HOUR', 'train_end')}, {T('a', 'test_start')}, {T('b', 'test_end')} FROM f",
    )
)
def stored_splits(spark, sf_dir):
    """Windows written as JSON and read back."""
    first, last = roles.table(spark, sf_dir, "orders").agg(F.min("o_orderdate"), F.date_trunc("month", F.max("o_orderdate"))).first()
    stored = splits.to_json(splits.walk_forward(first, last, test=24, fold=3, tuning=6, embargo_hours=24))
    return timed(splits.as_table(spark, splits.from_json(stored)), "train_end", "test_start", "test_end")


SETS = {"P": PRICE_COLUMNS, "P_ALL": features.feature_columns(["all"])}


@query(sql(TABLE, " UNION ALL ".join(f"SELECT symbol, '{name}' AS feature_set, '{c}' AS column_name, count({c}) AS filled FROM full_table GROUP BY symbol" for name, columns in SETS.items() for c in columns)))
def feature_sets(spark, sf_dir):
    """Filled values of every column of the feature sets."""
    per = model_table(spark, sf_dir).groupBy("symbol").agg(*[F.count(c).alias(c) for c in SETS["P_ALL"]])
    entries = F.array(*[F.struct(F.lit(name).alias("feature_set"), F.lit(c).alias("column_name"), F.col(c).alias("filled")) for name, columns in SETS.items() for c in columns])
    return per.select("symbol", F.inline(entries))


@query(
    sql(
        "d AS (SELECT count(*) AS declared FROM orders), r AS (SELECT count(*) AS read, avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END) AS zone_share FROM orders WHERE o_orderkey % 997 <> 0)",
        f"SELECT read, declared, abs(read - declared) <= 0.01 * declared AS size_ok, {R('zone_share', 'zone_share')}, zone_share BETWEEN 0.05 AND 0.95 AS mixed_zones FROM r, d",
    )
)
def input_size(spark, sf_dir):
    """Rows read against rows declared; some rows are lost, and every third time has a zone."""
    orders = roles.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("o_orderkey") % 3 == 0, "+03:00").otherwise("")).alias("written"))
    read = orders.filter("o_orderkey % 997 <> 0").select(times.has_zone(F.col("written")).alias("zoned"))
    return rounded(validate.input_size(read, orders.agg(F.count(F.lit(1)).alias("n")), "zoned"), "zone_share")


@query(sql("d AS (SELECT o_orderkey, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber <= 6) AS c FROM lineitem GROUP BY 1)".replace("SELECT o_orderkey", "SELECT l_orderkey"), "SELECT c.c >= 0.99 * d.n AS complete, count(*) AS orders FROM d JOIN c ON c.l_orderkey = d.l_orderkey GROUP BY 1"))
def collection_complete(spark, sf_dir):
    """Collected lines of each order against those declared; the seventh line of an order is never collected."""
    lines = roles.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    declared = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    got = validate.completeness(lines.filter("l_linenumber <= 6"), declared, ["l_orderkey"])
    return got.groupBy("complete").agg(F.count(F.lit(1)).alias("orders"))


@query(sql("l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1)", "SELECT d.doc_id, l.quality AS mark FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN l ON l.doc_id = d.doc_id"))
def key_sheet(spark, sf_dir):
    """A sheet of all ids with the marks of those that have one; ids must be unique on both sides."""
    ids = roles.table(spark, sf_dir, "documents").select("doc_id").distinct()
    marks = roles.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("mark"))
    validate.require(validate.one_to_one(marks, ids, "doc_id").filter("check <> 'unmatched'"), "key sheet")
    return ids.join(marks, "doc_id", "left")


@query(sql(NEWS, f"SELECT url, md5(title) AS title, {T('published', 'date_time')}, lang AS coin_type FROM news"))
def renamed_columns(spark, sf_dir):
    """Columns under the spellings of a file, brought to their own names."""
    news = timed(roles.headlines(spark, sf_dir), "published")
    spelt = news.select(F.col("url").alias(" Link"), F.md5("title").alias("Headline"), F.col("published").alias("Published-At"), F.col("lang").alias("CURRENCY"), "score")
    return files.rename_aliases(spelt)


MARKS = """m AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '<time class="x" datetime="' || strftime(ts, '%Y-%m-%d') || '"> "datePublished": "b"'
  WHEN 1 THEN '{"datePublished" : "' || strftime(ts, '%Y-%m-%d') || '"}' WHEN 2 THEN '<meta data-a property="article:published_time" content="' || strftime(ts, '%Y-%m-%d') || '">'
  WHEN 3 THEN '<meta itemprop="datePublished" content="' || strftime(ts, '%Y-%m-%d') || '">' ELSE '<p>none</p>' END AS markup, strftime(ts, '%Y-%m-%d') AS day FROM events)"""


@query(sql(MARKS, "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN day END AS published FROM m"))
def page_times(spark, sf_dir):
    """Publication days found in page markup of several kinds."""
    day, k = F.date_format("ts", "yyyy-MM-dd"), F.col("event_id") % 5
    markup = (
        F.when(k == 0, F.concat(F.lit('<time class="x" datetime="'), day, F.lit('"> "datePublished": "b"')))
        .when(k == 1, F.concat(F.lit('{"datePublished" : "'), day, F.lit('"}')))
        .when(k == 2, F.concat(F.lit('<meta data-a property="article:published_time" content="'), day, F.lit('">')))
        .when(k == 3, F.concat(F.lit('<meta itemprop="datePublished" content="'), day, F.lit('">')))
        .otherwise("<p>none</p>")
    )
    return roles.table(spark, sf_dir, "events").select("event_id", text.first_time(markup).alias("published"))


@query(f"SELECT page_id, regexp_matches(url, '{text.SLUG}') AND NOT regexp_matches(url, '{text.NO_ARTICLE}') AS article FROM pages")
def article_urls(spark, sf_dir):
    return roles.table(spark, sf_dir, "pages").select("page_id", text.is_article_url(F.col("url")).alias("article"))


@query("SELECT p_partkey, trim(regexp_replace(p_name || ' / ' || p_type, '[^\\p{L}\\p{N}._-]+', '-', 'g'), '-') AS slug, p_brand || ':' || CASE WHEN p_size % 2 = 0 THEN 'P_EN' ELSE 'P' END AS model_key FROM part")
def name_keys(spark, sf_dir):
    """Names as parts of file names, and keys of a model on a feature set."""
    rows = roles.table(spark, sf_dir, "part")
    chosen = F.when(F.col("p_size") % 2 == 0, "P_EN")
    return rows.select("p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"), text.model_key(F.col("p_brand"), chosen).alias("model_key"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '''=' WHEN 1 THEN '''-' WHEN 2 THEN '''@' ELSE '' END || o_orderpriority AS cell FROM orders")
def sheet_cells(spark, sf_dir):
    """Texts that a spreadsheet would take for formulas, made safe."""
    sign = F.element_at(F.array(*map(F.lit, ("=", "-", "@", ""))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return roles.table(spark, sf_dir, "orders").select("o_orderkey", text.sheet_safe(F.concat(sign, F.lit("\x01"), "o_orderpriority")).alias("cell"))


@query(
    sql(
        PAIRED + """, g AS (SELECT quality AS t, 'other_label' AS model, toxic AS p FROM y UNION ALL SELECT quality, 'constant', 1 FROM y), k AS (SELECT unnest([0, 1]) AS class),
        f AS (SELECT model, class, count(*) FILTER (WHERE t = class AND p = class) AS tp, count(*) FILTER (WHERE t = class) + count(*) FILTER (WHERE p = class) AS tot FROM g CROSS JOIN k GROUP BY model, class),
        m AS (SELECT model, avg(coalesce(2.0 * tp / nullif(tot, 0), 0)) AS macro_f1 FROM f GROUP BY model)""",
        f"SELECT model, {R('macro_f1', 'macro_f1')}, model = (SELECT model FROM m ORDER BY macro_f1 DESC, model DESC LIMIT 1) AS chosen FROM m",
    )
)
def model_choice(spark, sf_dir):
    """Macro F1 of two classifiers, from the bootstrap's own counts, and which is chosen."""
    labels = roles.table(spark, sf_dir, "labels").filter("quality is not null and toxic is not null")
    guesses = F.create_map(F.lit("other_label"), F.col("toxic"), F.lit("constant"), F.lit(1))
    rows = labels.select(F.monotonically_increasing_id().alias("item"), F.col("quality").alias("truth"), F.explode(guesses).alias("model", "predicted"))
    scores = resampling.f1_interval(rows, "truth", "predicted", "model", [0, 1], reps=1, seed=3).select("model", "macro_f1")
    best = annotate.choose(scores, ["other_label", "constant"]).select(F.col("model").alias("best"))
    return rounded(scores.crossJoin(F.broadcast(best)).select("model", "macro_f1", (F.col("model") == F.col("best")).alias("chosen")), "macro_f1")


@query(
    sql(
        BT + """, h AS (SELECT symbol, open_time, exp(least(y_true, 0.05)) - 1 - CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY open_time) = 1 THEN 0.001 ELSE 0 END AS net FROM pred WHERE model = 'zero'),
        z AS (SELECT symbol, avg(net) / stddev_samp(net) * sqrt(8760) AS base FROM h GROUP BY symbol),
        s AS (SELECT symbol, model, avg(net) / nullif(stddev_samp(net), 0) * sqrt(8760) AS sharpe FROM net WHERE strategy = 'long_flat' AND cost_bp = 10 GROUP BY 1, 2)""",
        f"SELECT s.symbol, s.model AS name, {R('s.sharpe - z.base', 'diff')} FROM s JOIN z ON z.symbol = s.symbol WHERE s.sharpe IS NOT NULL",
    )
)
def sharpe_differences(spark, sf_dir):
    """Point estimates of the bootstrap: each model's Sharpe ratio at 10 basis points less that of holding."""
    net = traded(spark, sf_dir).filter("strategy = 'long_flat' and cost_bp = 10").select("symbol", F.col("model").alias("name"), "open_time", "net")
    truth = predictions(spark, sf_dir).filter("model = 'zero'").withColumn("y_true", F.least("y_true", F.lit(0.05)))
    hold = backtest.net_returns(backtest.grid(truth, ["buy_and_hold"], [10]), KEYS).select("symbol", F.lit("hold").alias("name"), "open_time", "net")
    return rounded(resampling.sharpe_interval(net.unionByName(hold), "hold", reps=1, seed=11).select("symbol", "name", "diff"), "diff")


@query(sql(TABLE + hac("target", "all_sent_mean", "valid"), f"SELECT symbol, n, {R('wald', 'wald')} FROM w"))
def hac_slope(spark, sf_dir):
    """The Wald statistic of one slope with Newey-West covariance, in closed form."""
    rows = model_table(spark, sf_dir).filter("valid").select("symbol", "open_time", "target", "all_sent_mean")
    return rounded(regression.hac_wald(rows, ["symbol"], "target", ["all_sent_mean"], ["all_sent_mean"]).select("symbol", "n", "wald"), "wald")
