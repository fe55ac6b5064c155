"""Queries over hypotheses: users' event types as hypotheses, their events as evidence for or against."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import hypotheses as H
from ..operators import review, trust
from ..operators.state import LIFECYCLE
from ..sources.adapters import TWINS, observations
from ..sources.tables import read
from .trust_plane import NOW, TYPES

CUT = dt.datetime(2024, 1, 16)
STATES = tuple(LIFECYCLE)


def links(spark: SparkSession, sf_dir: str, until: dt.datetime | None = None) -> DataFrame:
    """Events of value 10 or more support, others oppose; until a time, if one is given."""
    rows = read(spark, sf_dir, "events")
    if until is not None:
        rows = rows.where(F.col("ts") < F.lit(f"{until:%Y-%m-%d}").cast("timestamp_ntz"))
    return rows.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("hypothesis_id"), F.col("event_id").alias("evidence_id"), (F.col("value") >= 10).alias("supports"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("evidence_id"), (F.col("event_id") % 7).alias("source_id"), (F.col("value") / 397.3).alias("authority"), F.col("ts").alias("seen"))


def heads(spark: SparkSession, sf_dir: str, until: dt.datetime | None = None) -> DataFrame:
    """hypothesis_id, user_id, status (by the user and the kind), n_assumptions."""
    rows = read(spark, sf_dir, "events")
    if until is not None:
        rows = rows.where(F.col("ts") < F.lit(f"{until:%Y-%m-%d}").cast("timestamp_ntz"))
    own = rows.select("user_id", "event_type").distinct()
    status = F.element_at(F.array(*map(F.lit, STATES)), ((F.col("user_id") + F.length("event_type")) % len(STATES) + 1).cast("int"))
    return own.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("hypothesis_id"), "user_id", "event_type", status.alias("status"), (F.col("user_id") % 5).cast("int").alias("n_assumptions"))


def required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources that a hypothesis needs."""
    return heads(spark, sf_dir).select("hypothesis_id", "status", F.explode(F.array(F.col("user_id") % 7, (F.col("user_id") + 3) % 7)).alias("source_id"))


def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the user's other hypotheses by supporting events, as a share of all its events."""
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") >= 10).alias("n"), F.count(F.lit(1)).alias("all"))
    user = Window.partitionBy("user_id")
    order = user.orderBy("event_type")
    other = F.greatest(F.max("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.max("n").over(order.rowsBetween(1, Window.unboundedFollowing)))
    return counts.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("hypothesis_id"), F.round(F.coalesce(other, F.lit(0)) / F.sum("all").over(user), 3).alias("alternative"))


def scores(spark: SparkSession, sf_dir: str, until: dt.datetime | None = None) -> DataFrame:
    severity = F.col("n_oppose") / (F.col("n_support") + F.col("n_oppose"))
    return H.components(links(spark, sf_dir, until), evidence(spark, sf_dir), NOW, severity, alternatives(spark, sf_dir), F.col("n_support") % 5, required(spark, sf_dir).drop("status"))


def hypothesis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir)


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hypothesis after the events from the cut on: its status before and after; a new event below 0.5 falsifies it."""
    c, fresh = F.col, F.col("ts") >= F.lit(f"{CUT:%Y-%m-%d}").cast("timestamp_ntz")
    news = read(spark, sf_dir, "events").groupBy(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("hypothesis_id")).agg(
        F.count_if(fresh & (c("value") >= 10)).alias("new_support"), F.count_if(fresh & (c("value") < 10)).alias("new_opposition"), F.coalesce(F.bool_or(fresh & (c("value") < 0.5)), F.lit(False)).alias("falsified")
    )
    rows = heads(spark, sf_dir).join(news, "hypothesis_id").join(scores(spark, sf_dir), "hypothesis_id")
    after = H.updated(c("status"), c("band").isin("high", "very_high"), c("independent"), c("n_oppose") > 0, c("severity"), c("new_support") > 0, c("new_opposition") > 0, c("falsified"))
    return rows.select("hypothesis_id", c("status").alias("before"), after.alias("after"), "new_support", "new_opposition", "band")


def hypothesis_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates(spark, sf_dir).drop("band")


def hypothesis_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed from the run at the cut to the run with all events."""
    old = heads(spark, sf_dir, CUT).join(scores(spark, sf_dir, CUT), "hypothesis_id").select("hypothesis_id", "status", "band")
    new = updates(spark, sf_dir).select("hypothesis_id", F.col("after").alias("status"), "band")
    return H.run_changes(old, new)


def lexical_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a statement, the next as evidence."""
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", following.alias("next"))
    sets = rows.select("conv_id", "turn", H.tokens(F.col("text")).alias("a"), H.tokens(F.col("next")).alias("b"))
    return sets.select("conv_id", "turn", H.lexical_verdict(F.col("a"), F.col("b")).alias("verdict"))


def explanation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hypotheses about their first lines' part groups; an order has few lines."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("hypothesis_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 50).alias("e")))).alias("l"))
    return H.explanation_groups(lines.select("hypothesis_id", F.transform("l", lambda x: x["e"].cast("string")).alias("entities")))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = required(spark, sf_dir).select("hypothesis_id", "status", F.concat(F.lit("evidence of source "), F.col("source_id").cast("string"), F.lit(" for "), F.substring_index("hypothesis_id", ":", 1)).alias("question"))
    return H.derived_gaps(needs, trust.contradictions(observations(spark, sf_dir)))


def derived_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(spark, sf_dir)


def gap_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty gaps of the highest value."""
    return gaps(spark, sf_dir).orderBy(F.col("value").desc(), "question").limit(20)


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five possible tests of each hypothesis."""
    kinds = F.array(*map(F.lit, ("falsify", "discriminate", "check_assumption")))
    seq = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seq")
    rows = heads(spark, sf_dir).select("hypothesis_id", "user_id", "status", seq)
    return rows.select("hypothesis_id", "status", "seq", F.element_at(kinds, ((F.col("user_id") + F.col("seq")) % 3 + 1).cast("int")).alias("kind"), ((F.col("user_id") * 7 + F.col("seq") * 3) % 4).alias("priority"))


def derived_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.derived_actions(tests(spark, sf_dir))


def action_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight next actions: falsification first, then by value."""
    rows = H.derived_actions(tests(spark, sf_dir))
    return rows.orderBy((F.col("kind") != "falsify").cast("int"), F.col("value").desc(), "hypothesis_id", "seq").limit(8)


def weakest_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    against = links(spark, sf_dir).groupBy("hypothesis_id").agg(F.count_if(~F.col("supports")).alias("n_oppose"))
    return H.weakest(heads(spark, sf_dir).join(against, "hypothesis_id"))


def top_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best live hypotheses."""
    live = heads(spark, sf_dir).where(F.col("status").isin(*H.LIVE)).select("hypothesis_id", "status")
    return live.join(scores(spark, sf_dir).select("hypothesis_id", "score", "band"), "hypothesis_id").orderBy(F.col("score").desc(), "hypothesis_id").limit(5)


def knowledge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each fifth of the users: live hypotheses, supported and contested claims, gaps, and the share that is settled."""
    rows = heads(spark, sf_dir).withColumn("case_id", F.col("user_id") % 5)
    sums = rows.groupBy("case_id").agg(
        F.count_if(F.col("status").isin(*H.LIVE)).alias("live"), F.count_if(F.col("status") == "supported").alias("supported"), F.count_if(F.col("status").isin("proposed", "disputed")).alias("contested"), F.count_if(F.col("status") == "inconclusive").alias("open_gaps")
    )
    total = F.col("supported") + F.col("contested") + F.col("open_gaps")
    return sums.withColumn("completion", F.round(F.coalesce(F.try_divide(F.col("supported"), total), F.lit(0.0)), 6))


def competing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's hypotheses of the same status compete."""
    own = heads(spark, sf_dir).select("user_id", "status", "hypothesis_id")
    a, b = own.toDF("user_id", "status", "left_id"), own.toDF("user_id", "status", "right_id")
    return a.join(b, ["user_id", "status"]).where("left_id < right_id").select("left_id", "right_id")


def overlay_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = heads(spark, sf_dir)
    assumed = own.where("n_assumptions > 0").select("hypothesis_id", F.explode(F.sequence(F.lit(0), F.col("n_assumptions") - 1)).alias("nth"))
    needed = own.select("hypothesis_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("nth"))
    return H.overlay_edges(links(spark, sf_dir), assumed, needed, competing(spark, sf_dir))


def hypothesis_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules keep each hypothesis out; parts of it are left blank by its user."""
    u = F.col("user_id")
    some = lambda test, *values: F.when(test, F.array(*map(F.lit, values))).otherwise(F.array().cast("array<string>"))
    rows = heads(spark, sf_dir).select(
        "hypothesis_id", F.when(u % 11 != 0, F.col("event_type")).alias("statement"), some(u % 3 != 0, "a condition").alias("falsifications"), some(u % 4 != 0, "a test").alias("falsification_tests"), F.when(u % 5 != 0, "a next test").alias("next_test"),
        some(u % 6 != 0, "another reading").alias("alternative_explanations"), F.array(F.concat(F.lit("claim-"), (u % 40).cast("string"))).alias("supporting_fact_ids"),
    )
    facts = heads(spark, sf_dir).where("status = 'supported'").select(F.concat(F.lit("claim-"), (u % 30).cast("string")).alias("fact_id"))
    return review.hypothesis_review(rows, facts).select("hypothesis_id", F.array_join("problems", "; ").alias("problems"))


QUERIES = {
    f.__name__: f
    for f in (
        hypothesis_scores, hypothesis_updates, hypothesis_history, lexical_verdicts, explanation_groups, derived_gaps, gap_brief, derived_actions, action_brief, weakest_link, top_hypotheses, knowledge_state, overlay_edges, hypothesis_admission,
    )
}

_STATUS = f"({list(STATES)})[(user_id + length(event_type)) % {len(STATES)} + 1]"
_HEADS = f"WITH heads AS (SELECT DISTINCT event_type || ':' || user_id AS hypothesis_id, user_id, event_type, {_STATUS} AS status, (user_id % 5)::INTEGER AS n_assumptions FROM events), req AS (SELECT hypothesis_id, status, unnest([user_id % 7, (user_id + 3) % 7]) AS source_id FROM heads) "


_ALT = """, alt AS (SELECT event_type || ':' || user_id AS hypothesis_id, round(coalesce(max(n) OVER (PARTITION BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0) / sum(al) OVER (PARTITION BY user_id), 3) AS alternative
        FROM (SELECT user_id, event_type, count_if(value >= 10) AS n, count(*) AS al FROM events GROUP BY 1, 2)) """


def _scores(name: str, where: str) -> str:
    """CTEs that end in a table `name` of scores of the events of a WHERE."""
    return f""",
      {name}_e AS (SELECT event_type || ':' || user_id AS hypothesis_id, value >= 10 AS s, event_id % 7 AS source_id, value / 397.3::DOUBLE AS authority, exp(greatest((epoch_us(TIMESTAMP '2024-02-05') - epoch_us(ts)) / 86.4e9, 0.0) * (-ln(2) / 30.0)) AS fr FROM events WHERE {where}),
      {name}_a AS (SELECT hypothesis_id, count_if(s)::BIGINT AS n_support, count_if(NOT s)::BIGINT AS n_oppose, round(coalesce(avg(CASE WHEN s THEN authority END), 0.0), 3) AS authority, count(DISTINCT CASE WHEN s THEN source_id END) AS independent,
        round(coalesce(avg(CASE WHEN s THEN fr END), 0.0), 6) AS fresh FROM {name}_e GROUP BY 1),
      {name}_c AS (SELECT hypothesis_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM {name}_e e WHERE e.hypothesis_id = r.hypothesis_id AND e.source_id = r.source_id AND e.s) THEN 1.0 ELSE 0.0 END), 3) AS share FROM (SELECT DISTINCT hypothesis_id, source_id FROM req) r GROUP BY 1),
      {name}_b AS (SELECT a.*, round(least(1.0::DOUBLE, n_support / 5.0), 3) AS strength, round(n_oppose / (n_support + n_oppose), 3) AS severity, coalesce(share, CASE WHEN n_support > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS coverage, coalesce(alternative, 0.0)::DOUBLE AS alternative,
        (n_support % 5)::INTEGER AS burden, round((n_support - n_oppose) / (n_support + n_oppose), 6) AS balance FROM {name}_a a LEFT JOIN {name}_c USING (hypothesis_id) LEFT JOIN alt USING (hypothesis_id)),
      {name}_t AS (SELECT *, (CASE WHEN n_oppose = 0 THEN 1.0 WHEN severity > 0.5 THEN 0.4 ELSE 0.7 END)::DOUBLE AS temporal FROM {name}_b),
      {name}_s AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.3 * strength + 0.2 * least(1.0::DOUBLE, independent / 3.0) + 0.15 * temporal + 0.15::DOUBLE + 0.1 * fresh + 0.05 * coverage - 0.1 * severity - 0.05 * least(burden, 4) - 0.15 * alternative)), 5) AS score FROM {name}_t),
      {name} AS (SELECT *, CASE WHEN score < 0.2 THEN 'very_low' WHEN score < 0.4 THEN 'low' WHEN score < 0.6 THEN 'moderate' WHEN score < 0.8 THEN 'high' ELSE 'very_high' END AS band FROM {name}_s) """


def _moved(status: str, target: str) -> str:
    return f"CASE WHEN {status} IN {tuple([s for s, after in LIFECYCLE.items() if target in after] + [''])} THEN '{target}' ELSE {status} END"


_BEGUN = "CASE WHEN status IN ('proposed', 'active') THEN 'testing' ELSE status END"
_TESTED = f"CASE WHEN status IN {tuple(s for s, after in LIFECYCLE.items() if 'falsified' in after)} THEN status ELSE {_moved('status', 'testing')} END"
_UPDATES = _ALT + _scores("sc", "true") + f""", news AS (SELECT event_type || ':' || user_id AS hypothesis_id, count_if(ts >= '2024-01-16' AND value >= 10)::BIGINT AS new_support, count_if(ts >= '2024-01-16' AND value < 10)::BIGINT AS new_opposition,
      bool_or(ts >= '2024-01-16' AND value < 0.5) AS falsified FROM events GROUP BY 1),
    u0 AS (SELECT hypothesis_id, status AS before, new_support, new_opposition, band, falsified, {_BEGUN} AS begun, {_TESTED} AS tested, band IN ('high', 'very_high') AND n_oppose = 0 AS strong, independent, n_oppose, severity FROM heads JOIN news USING (hypothesis_id) JOIN sc USING (hypothesis_id)),
    u AS (SELECT hypothesis_id, before, new_support, new_opposition, band, CASE WHEN falsified THEN {_moved('tested', 'falsified')} WHEN strong AND independent >= 2 THEN {_moved('begun', 'supported')} WHEN strong THEN {_moved('begun', 'strengthened')}
      WHEN n_oppose > 0 AND severity > 0.5 THEN {_moved('begun', 'disputed')} WHEN new_opposition > 0 THEN {_moved('begun', 'weakened')} WHEN new_support > 0 THEN {_moved('begun', 'strengthened')} ELSE begun END AS after FROM u0) """  # fmt: skip
_GAPS = TWINS["observations"] + """, heads AS (SELECT DISTINCT event_type || ':' || user_id AS hypothesis_id, user_id, event_type, """ + _STATUS + """ AS status FROM events), n AS (SELECT hypothesis_id, 'evidence of source ' || source_id || ' for ' || event_type AS question
      FROM (SELECT hypothesis_id, event_type, unnest([user_id % 7, (user_id + 3) % 7]) AS source_id FROM heads WHERE status NOT IN ('falsified', 'archived'))),
    g AS (SELECT question, 'required to test ' || min(hypothesis_id) AS why, 0.6::DOUBLE AS value, 'high' AS priority FROM n GROUP BY 1 UNION ALL
      SELECT 'Resolve conflict: ' || lower(subject) || ' ' || lower(predicate), 'unresolved contradiction blocks verification', 0.8, 'high' FROM obs GROUP BY lower(subject), lower(predicate) HAVING count(DISTINCT lower(trim(value))) > 1) """
_ACTIONS = _HEADS + """, t AS (SELECT hypothesis_id, user_id, status, unnest([0, 1, 2, 3, 4]) AS seq FROM heads WHERE status NOT IN ('falsified', 'archived')), k AS (SELECT hypothesis_id, seq, (['falsify', 'discriminate', 'collect'])[(user_id + seq) % 3 + 1] AS kind, (user_id * 7 + seq * 3) % 4 AS p FROM t),
    a AS (SELECT hypothesis_id, seq, kind, round(0.4 + 0.2 * p, 3)::DOUBLE AS value FROM k QUALIFY row_number() OVER (PARTITION BY hypothesis_id ORDER BY p DESC, seq) <= 3) """
_COLUMNS = "hypothesis_id, n_support, n_oppose, strength, authority, independent, temporal, coverage, fresh, severity, alternative, burden, balance, score, band"
ORACLES = {
    "hypothesis_scores": _HEADS + _ALT + _scores("sc", "true") + f"SELECT {_COLUMNS} FROM sc",
    "hypothesis_updates": _HEADS + _UPDATES + "SELECT hypothesis_id, before, after, new_support, new_opposition FROM u",
    "hypothesis_history": _HEADS + _UPDATES + _scores("pre", "ts < '2024-01-16'") + """, old AS (SELECT hypothesis_id, status, list_position(['very_low', 'low', 'moderate', 'high', 'very_high'], band) AS b FROM heads JOIN pre USING (hypothesis_id)),
        fresh AS (SELECT hypothesis_id, after AS status, list_position(['very_low', 'low', 'moderate', 'high', 'very_high'], band) AS b FROM u),
        d AS (SELECT coalesce(o.hypothesis_id, f.hypothesis_id) AS hypothesis_id, CASE WHEN o.hypothesis_id IS NULL THEN 'added' WHEN f.hypothesis_id IS NULL THEN 'removed' WHEN o.status = f.status THEN NULL WHEN f.status = 'falsified' THEN 'falsified' WHEN f.b > o.b THEN 'strengthened' WHEN f.b < o.b THEN 'weakened' ELSE 'status' END AS kind,
          coalesce(o.status, '') AS from_status, coalesce(f.status, '') AS to_status FROM old o FULL JOIN fresh f ON o.hypothesis_id = f.hypothesis_id) SELECT * FROM d WHERE kind IS NOT NULL""",
    "lexical_verdicts": """WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{3,}')) AS a, list_distinct(regexp_extract_all(lower(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')), '[a-z0-9_]{3,}')) AS b FROM conversations),
        n AS (SELECT *, len(list_intersect(a, b)) AS i FROM t) SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 'unknown' WHEN i >= 0.25 * (len(a) + len(b) - i) THEN 'consistent' WHEN i <= 0.05 * (len(a) + len(b) - i) THEN 'neutral' ELSE 'unknown' END AS verdict FROM n""",
    "explanation_groups": """WITH o AS (SELECT l_orderkey AS h, list((l_partkey % 50)::VARCHAR ORDER BY l_linenumber, l_partkey % 50) AS e FROM lineitem GROUP BY 1)
        SELECT array_to_string(list_sort(list_distinct(e[1:3])), ',') AS entities, count(*) AS n_hypotheses, min(h) AS first_id FROM o GROUP BY 1 HAVING count(*) >= 2""",
    "derived_gaps": _GAPS + "SELECT question, why, value, priority FROM g",
    "gap_brief": _GAPS + "SELECT question, why, value, priority FROM g ORDER BY value DESC, question LIMIT 20",
    "derived_actions": _ACTIONS + "SELECT * FROM a",
    "action_brief": _ACTIONS + "SELECT * FROM a ORDER BY kind <> 'falsify', value DESC, hypothesis_id, seq LIMIT 8",
    "weakest_link": _HEADS + ", o AS (SELECT event_type || ':' || user_id AS hypothesis_id, count_if(value < 10)::BIGINT AS n_oppose FROM events GROUP BY 1) SELECT hypothesis_id, n_assumptions, n_oppose, n_assumptions + n_oppose AS load FROM heads JOIN o USING (hypothesis_id) WHERE n_assumptions + n_oppose > 0 ORDER BY load DESC, hypothesis_id LIMIT 1",
    "top_hypotheses": _HEADS + _ALT + _scores("sc", "true") + f"SELECT hypothesis_id, status, score, band FROM heads JOIN sc USING (hypothesis_id) WHERE status IN {H.LIVE} ORDER BY score DESC, hypothesis_id LIMIT 5",
    "knowledge_state": _HEADS + f""", k AS (SELECT user_id % 5 AS case_id, count_if(status IN {H.LIVE})::BIGINT AS live, count_if(status = 'supported')::BIGINT AS supported, count_if(status IN ('proposed', 'disputed'))::BIGINT AS contested, count_if(status = 'inconclusive')::BIGINT AS open_gaps FROM heads GROUP BY 1)
        SELECT *, round(coalesce(supported / nullif(supported + contested + open_gaps, 0), 0.0), 6)::DOUBLE AS completion FROM k""",
    "overlay_edges": _HEADS + """SELECT event_type || ':' || user_id AS source, CASE WHEN value >= 10 THEN 'supported_by' ELSE 'opposed_by' END AS kind, event_id::VARCHAR AS target FROM events
        UNION ALL SELECT hypothesis_id, 'depends_on', hypothesis_id || '-assumption-' || unnest(range(n_assumptions)) FROM heads UNION ALL SELECT hypothesis_id, 'requires', hypothesis_id || '-missing-' || unnest([0, 1]) FROM heads
        UNION ALL SELECT a.hypothesis_id, 'competes_with', b.hypothesis_id FROM heads a JOIN heads b ON a.user_id = b.user_id AND a.status = b.status AND a.hypothesis_id <> b.hypothesis_id""",
    "hypothesis_admission": _HEADS + """, f AS (SELECT DISTINCT user_id % 30 AS k FROM heads WHERE status = 'supported')
        SELECT hypothesis_id, coalesce(array_to_string(list_filter([CASE WHEN (SELECT count(*) FROM f) = 0 THEN 'no gated facts, and neither opposition nor unknowns declared' END, CASE WHEN user_id % 11 = 0 THEN 'empty statement' END, CASE WHEN user_id % 3 = 0 THEN 'no falsification condition' END,
          CASE WHEN user_id % 3 <> 0 AND user_id % 4 = 0 THEN 'falsification without condition or test' END, CASE WHEN user_id % 5 = 0 THEN 'no next test' END, CASE WHEN user_id % 6 = 0 THEN 'no alternative explanation' END,
          CASE WHEN user_id % 40 NOT IN (SELECT k FROM f) THEN 'refers to facts that were not gated' END], lambda x: x IS NOT NULL), '; '), '') AS problems FROM heads""",
}
