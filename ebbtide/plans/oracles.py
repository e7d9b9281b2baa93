"""The same results in DuckDB SQL, written the straightforward way.

These are checks, not plans: joins fan out, ranks use one global window, medians use the
built-in. Queries that fit a model publish what must hold for any fit.
"""

from __future__ import annotations

from ebbtide.operators.features import MEDIAN_FILLED, SAFE_FEATURES, ZERO_FILLED
from ebbtide.operators.labels import BASE_COLUMNS, REALISTIC_COLUMNS
from ebbtide.operators.noise import FLOORED, PERCENTAGES
from ebbtide.operators.series import COUNTED, FEATURES, METRICS

AS_OF = "DATE '2024-01-31'"
SEED = 42
PI2 = "6.283185307179586::DOUBLE"

# Expected actions, stated here by themselves so that a change of the rule tables shows.
LIVE = {
    "churned": ["churned/mail", "churned/call", "churned/offer", "churned/in_app"],
    "critical": ["critical/mail", "critical/call", "critical/offer", "critical/in_app", "critical/coach"],
    "high": ["high/mail", "high/call", "high/offer", "high/in_app", "high/coach"],
    "moderate": ["moderate/mail", "moderate/call", "moderate/offer", "moderate/in_app"],
    "stable": ["stable/mail", "stable/call", "stable/offer"],
    "engagement_low": ["engagement_low/mail", "engagement_low/call", "engagement_low/offer", "engagement_low/in_app"],
    "engagement_fair": ["engagement_fair/mail", "engagement_fair/call"],
    "falling": ["falling/mail", "falling/call", "falling/offer", "falling/in_app"],
    "rising": ["rising/mail", "rising/call"],
    "idle": ["idle/mail", "idle/call", "idle/offer"],
    "few_quizzes": ["few_quizzes/mail", "few_quizzes/call", "few_quizzes/offer"],
}
SHORT = {
    "churned": ["churned/mail", "churned/call", "churned/offer"],
    "critical": ["critical/mail", "critical/call", "critical/offer"],
    "high": ["high/mail", "high/call", "high/offer"],
    "moderate": ["moderate/mail", "moderate/call"],
    "engagement_low": ["engagement_low/mail", "engagement_low/call"],
    "falling": ["falling/mail", "falling/call"],
    "idle": ["idle/mail", "idle/call"],
}
BY_TIER = {
    "critical": ["critical/mail", "critical/call", "critical/offer"],
    "high": ["high/mail", "high/call", "high/offer"],
    "moderate": ["moderate/mail", "moderate/call", "moderate/offer"],
    "stable": ["stable/mail", "stable/call", "stable/offer"],
}


def r(expression: str, name: str | None = None, digits: int = 8) -> str:
    return f"round(({expression})::DOUBLE + 1e-11::DOUBLE, {digits}) AS {name or expression}"


def u(keys: str, salt: str, part: int = 0) -> str:
    return (
        f"(('0x' || substr(md5(concat_ws('|', {keys}, '{salt}')), {1 + 8 * part}, 8))::BIGINT"
        " / 4294967296.0::DOUBLE)"
    )


def z(keys: str, salt: str, part: int = 0) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u(keys, salt, part)})) * cos({PI2} * {u(keys, salt, part + 1)}))"


def div(top: str, bottom: str) -> str:
    return f"({top})::DOUBLE / CASE WHEN {bottom} = 0 THEN 1.0::DOUBLE ELSE ({bottom})::DOUBLE END"


DIVERSITY = """(coalesce(total_quiz_attempts > 0, false)::INT + coalesce(total_content_views > 0, false)::INT
    + coalesce(total_challenge_interactions > 0, false)::INT)"""
VOLUME = "(total_quiz_attempts + total_content_views + total_challenge_interactions)"


def rollup_sql(copies_from: str) -> str:
    return f"""
    SELECT u.user_key, u.user_id, u.age, u.account_status, u.is_verified, u.registration_date,
        coalesce(max(a.last_activity_date), u.registration_date) AS last_activity_date,
        coalesce(avg(a.avg_session_duration), 0) AS avg_session_duration,
        coalesce(sum(a.session_count), 0)::BIGINT AS total_sessions,
        coalesce(avg(e.engagement_score), 50) AS avg_engagement,
        coalesce(max(e.days_since_last_login), 15)::INT AS days_since_last_login,
        coalesce(max(e.current_streak), 0)::INT AS current_streak,
        coalesce(max(e.longest_streak), 0)::INT AS longest_streak,
        coalesce(avg(e.quiz_accuracy_percentage), 50) AS quiz_accuracy,
        coalesce(avg(e.challenge_completion_rate), 50) AS challenge_completion,
        coalesce(max(e.stagnation_days), 10)::INT AS stagnation_days,
        coalesce(sum(a.quiz_attempts), 0)::BIGINT AS total_quiz_attempts,
        coalesce(sum(a.quiz_completions), 0)::BIGINT AS total_quiz_completions,
        coalesce(sum(a.quiz_abandons), 0)::BIGINT AS total_quiz_abandons,
        coalesce(sum(a.content_views), 0)::BIGINT AS total_content_views,
        coalesce(sum(a.challenge_interactions), 0)::BIGINT AS total_challenge_interactions
    FROM dim_users u
    LEFT JOIN fact_activity a ON u.user_key = a.user_key
    LEFT JOIN {copies_from} e ON u.user_key = e.user_key
    WHERE u.account_status IN ('active', 'pending', 'suspended')
    GROUP BY u.user_key, u.user_id, u.age, u.account_status, u.is_verified, u.registration_date"""


def when(condition: str, names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"CASE WHEN {condition} THEN [{listed}] ELSE []::VARCHAR[] END"


def tier(table: dict, mean: str) -> str:
    limits = {
        "critical": f"{mean} > 0.7", "high": f"{mean} > 0.5 AND {mean} <= 0.7",
        "moderate": f"{mean} > 0.3 AND {mean} <= 0.5", "stable": f"{mean} <= 0.3",
    }
    parts = [when(limits[t], table[t]) for t in limits if t in table]
    return " || ".join(f"({p})" for p in parts)


CHURNED_CODES = ", ".join("'" + c + "'" for c in LIVE["churned"])
ACTIONS_LIVE = f"""CASE WHEN current_churned_status = 1 THEN [{CHURNED_CODES}] ELSE {tier(LIVE, 'exact_mean')}
    || ({when('avg_engagement < 30', LIVE['engagement_low'])})
    || ({when('avg_engagement >= 30 AND avg_engagement < 50', LIVE['engagement_fair'])})
    || ({when('engagement_trend < -10', LIVE['falling'])})
    || ({when('engagement_trend > 10', LIVE['rising'])})
    || ({when('low_activity_days > 7', LIVE['idle'])})
    || ({when('low_quiz_days > 5', LIVE['few_quizzes'])}) END"""
ACTIONS_CLASSIC = f"""({when('current_churned_status = 1', SHORT['churned'])}) || {tier(SHORT, 'exact_mean')}
    || ({when('avg_engagement < 30', SHORT['engagement_low'])})
    || ({when('engagement_trend < -10', SHORT['falling'])})
    || ({when('low_activity_days > 7', SHORT['idle'])})"""


def series_feature_columns() -> str:
    early = "FILTER (day_offset < -15)"
    parts = []
    for m in METRICS:
        parts += [
            f"avg({m}) {early} AS {m}_mean", f"stddev_pop({m}) {early} AS {m}_std",
            f"min({m}) {early} AS {m}_min", f"max({m}) {early} AS {m}_max",
            f"max_by({m}, day_offset) {early} AS {m}_last", f"sum({m}) {early} AS {m}_sum",
            f"(count(*) FILTER (day_offset < -15 AND {m} > 0))::DOUBLE AS {m}_active_days",
            f"coalesce(regr_slope({m}, day_offset) {early}, 0) AS {m}_slope",
        ]
    return ", ".join(parts)


ORDERED = "ORDER BY score DESC ROWS UNBOUNDED PRECEDING"
# Named pieces; each may use the ones before it.
PIECES = {
    "dim_users": """
    SELECT c_custkey AS user_key, c_name AS user_id,
        CASE WHEN c_acctbal >= 0 THEN (13 + trunc(c_acctbal)::BIGINT % 52)::INT END AS age,
        CASE c_mktsegment WHEN 'MACHINERY' THEN 'suspended' WHEN 'FURNITURE' THEN 'pending'
            WHEN 'AUTOMOBILE' THEN 'deleted' ELSE 'active' END AS account_status,
        c_acctbal > 0 AS is_verified,
        (SELECT min(o_orderdate)::DATE FROM orders WHERE o_custkey = c_custkey) AS registration_date
    FROM customer""",
    "daily": """
    SELECT user_id AS user_key, ts::DATE AS last_activity_date,
        count(DISTINCT hour(ts)) AS session_count, avg(value) AS avg_session_duration,
        least(100.0, sum(value)) AS engagement_score,
        count(*) FILTER (event_type IN ('click', 'purchase')) AS quiz_attempts,
        count(*) FILTER (event_type = 'purchase') AS quiz_completions,
        count(*) FILTER (event_type = 'error') AS quiz_abandons,
        count(*) FILTER (event_type = 'view') AS content_views,
        count(*) FILTER (event_type = 'signup') AS challenge_interactions
    FROM events GROUP BY ALL""",
    "fact_activity": """
    SELECT user_key, avg_session_duration, session_count, last_activity_date, quiz_attempts,
        quiz_completions, quiz_abandons, content_views, challenge_interactions FROM daily""",
    "fact_engagement": f"""
    SELECT o_custkey AS user_key, least(100.0, avg(o_totalprice) / 5000) AS engagement_score,
        any_value(idle)::INT AS days_since_last_login, count(DISTINCT month(o_orderdate))::INT AS current_streak,
        count(*)::INT AS longest_streak,
        100 * avg((o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT) AS quiz_accuracy_percentage,
        least(100.0, max(o_totalprice) / 5000) AS challenge_completion_rate,
        any_value(unsold)::INT AS stagnation_days
    FROM orders LEFT JOIN (
        SELECT user_id, {AS_OF} - max(ts)::DATE AS idle,
            {AS_OF} - (max(ts) FILTER (event_type = 'purchase'))::DATE AS unsold FROM events GROUP BY user_id
    ) ON user_id = o_custkey
    GROUP BY o_custkey, year(o_orderdate)""",
    "rollup": rollup_sql("fact_engagement"),
    "base": f"""
    SELECT * EXCLUDE (age, registration_date), coalesce(age, 13) AS age,
        (coalesce({AS_OF} - last_activity_date, 99) > 14 OR days_since_last_login > 14
            OR account_status = 'suspended' OR (days_since_last_login > 10 AND avg_engagement < 30)
            OR (days_since_last_login > 7 AND total_sessions < 5) OR stagnation_days > 20)::INT AS churned,
        if(last_activity_date IS NULL, 30, greatest({AS_OF} - last_activity_date, 0))::INT AS days_since_last_activity
    FROM rollup""",
    "realistic": f"""
    SELECT * EXCLUDE (is_verified, days_since_last_login, stagnation_days, idle),
        (coalesce({AS_OF} - last_activity_date, 0) > 30 OR account_status = 'suspended'
            OR (total_sessions < 3 AND avg_engagement < 25))::INT AS churned_realistic,
        if(idle > 21, 'high_risk', if(idle > 14, 'medium_risk',
            if(avg_engagement < 30 AND total_sessions < 5, 'low_engagement', 'active'))) AS risk_category
    FROM (SELECT *, coalesce({AS_OF} - last_activity_date, 0) AS idle FROM rollup)""",
    "derived": f"""
    SELECT *, total_sessions / 30.0::DOUBLE AS session_frequency,
        {div('total_quiz_completions', 'total_quiz_attempts')} AS quiz_completion_rate,
        {div('total_quiz_abandons', 'total_quiz_attempts')} AS quiz_abandon_rate,
        avg_engagement - stagnation_days / 30.0::DOUBLE * 100 AS engagement_trend,
        {DIVERSITY} AS activity_diversity, challenge_completion / 100 AS challenge_success_ratio,
        {div('current_streak', 'longest_streak')} AS consistency_index
    FROM base""",
    "imputed": f"""
    SELECT user_key, churned_realistic AS churned,
        {', '.join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in MEDIAN_FILLED)},
        {', '.join(f"coalesce({c}, 0) AS {c}" for c in ZERO_FILLED)}
    FROM realistic""",
    "safe": f"""
    SELECT *, {div('total_quiz_completions', 'total_quiz_attempts')} AS quiz_success_rate,
        {div('total_quiz_abandons', 'total_quiz_attempts')} AS quiz_abandon_rate,
        {DIVERSITY} AS activity_diversity, {VOLUME} AS total_activity_volume,
        {div(VOLUME, 'total_sessions')} AS activity_per_session,
        {div('total_quiz_completions', 'total_sessions')} AS quiz_efficiency
    FROM imputed""",
    "leaking": "SELECT *, churned * 10 + total_sessions % 3 AS leak FROM safe",
    "spine": "SELECT user_key, unnest(generate_series(-30, -1))::INT AS day_offset FROM rollup",
    "dense": f"""
    SELECT s.user_key, s.day_offset, d.user_key IS NOT NULL AS active,
        coalesce(d.avg_session_duration, 0)::DOUBLE AS session_duration,
        coalesce(d.session_count, 0)::DOUBLE AS sessions_count,
        {', '.join(f"coalesce(d.{m}, 0)::DOUBLE AS {m}" for m in COUNTED[2:])}
    FROM spine s LEFT JOIN daily d ON d.user_key = s.user_key AND d.last_activity_date = {AS_OF} + s.day_offset""",
    "series": """
    SELECT *, (day_offset - coalesce(max(CASE WHEN NOT active THEN day_offset END) OVER past, -31))::DOUBLE AS login_streak,
        coalesce(day_offset - max(CASE WHEN active THEN day_offset END) OVER past, 30)::DOUBLE AS days_since_login
    FROM dense WINDOW past AS (PARTITION BY user_key ORDER BY day_offset ROWS UNBOUNDED PRECEDING)""",
    "features": f"SELECT user_key, {series_feature_columns()} FROM series GROUP BY user_key HAVING count(*) >= 30",
    "targets": f"SELECT user_key, day_offset + 16 AS horizon_day, {', '.join(METRICS)} FROM series WHERE day_offset >= -15",
    "trend": f"""
    SELECT user_key, horizon_day,
        {', '.join(f"round(greatest(0, {m}_mean + {m}_slope * (horizon_day + 7)) + 1e-9::DOUBLE, 6) AS {m}" for m in METRICS)}
    FROM features, (SELECT unnest(generate_series(1, 15))::INT AS horizon_day)""",
    "scored": f"""
    SELECT r.user_id, t.user_key, horizon_day AS prediction_day, {AS_OF} + horizon_day AS predicted_date,
        r.churned_realistic AS current_churned_status,
        {', '.join(f"t.{m} AS predicted_{m}" for m in METRICS)},
        least(10, CASE WHEN days_since_login > 7 THEN 4 WHEN days_since_login > 3 THEN 2 ELSE 0 END
            + CASE WHEN engagement_score < 30 THEN 3 WHEN engagement_score < 50 THEN 1 ELSE 0 END
            + CASE WHEN sessions_count = 0 THEN 2 ELSE 0 END
            + CASE WHEN t.quiz_attempts = 0 THEN 1 ELSE 0 END)::INT AS risk_tenths,
        CASE WHEN engagement_score >= 70 THEN 'high' WHEN engagement_score >= 40 THEN 'medium'
            ELSE 'low' END AS predicted_engagement_level
    FROM trend t JOIN realistic r USING (user_key)""",
    "forecast": "SELECT *, risk_tenths / 10.0::DOUBLE AS predicted_churn_risk FROM scored",
    "risk": f"""
    SELECT user_key, user_id, any_value(current_churned_status) AS current_churned_status, count(*) AS days,
        sum(risk_tenths)::BIGINT AS risk_sum, max(risk_tenths) AS risk_max,
        count(*) FILTER (risk_tenths > 7) AS days_high_risk, avg(predicted_engagement_score) AS avg_engagement,
        last(predicted_engagement_score ORDER BY prediction_day)
            - first(predicted_engagement_score ORDER BY prediction_day) AS engagement_trend,
        count(*) FILTER (predicted_sessions_count = 0) AS low_activity_days,
        count(*) FILTER (predicted_quiz_attempts = 0) AS low_quiz_days,
        sum(risk_tenths) / (10.0::DOUBLE * count(*)) AS avg_churn_risk,
        max(risk_tenths) / 10.0::DOUBLE AS max_churn_risk,
        sum(risk_tenths)::DECIMAL(18, 4) / (10 * count(*))::DECIMAL(18, 4) AS exact_mean
    FROM forecast GROUP BY user_key, user_id""",
    "live": f"SELECT *, {ACTIONS_LIVE} AS recommendations FROM risk",
    "scores": f"""
    SELECT user_key, churned_realistic AS churned, round(least(1.0, (days_since_last_login / 30.0::DOUBLE * 0.4::DOUBLE
        + (100 - r.avg_engagement) / 100 * 0.3::DOUBLE) * 2) + 1e-11::DOUBLE, 8) AS score
    FROM rollup r JOIN (SELECT user_key, churned_realistic FROM realistic) USING (user_key)""",
    "by_score": "SELECT score, sum(churned)::BIGINT AS pos, sum(1 - churned)::BIGINT AS neg FROM scores GROUP BY score",
    "totals": f"""
    SELECT *, sum(pos) OVER ({ORDERED})::DOUBLE AS tp, sum(neg) OVER ({ORDERED})::DOUBLE AS fp,
        sum(pos) OVER ()::DOUBLE AS p, sum(neg) OVER ()::DOUBLE AS n,
        lead(pos) OVER (ORDER BY score DESC) AS next_pos, lead(neg) OVER (ORDER BY score DESC) AS next_neg,
        row_number() OVER (ORDER BY score DESC) AS place
    FROM by_score""",
    "roc": "SELECT place, score AS threshold, fp / n AS fpr, tp / p AS tpr FROM totals UNION ALL SELECT 0, NULL, 0, 0",
    "pr": """SELECT place, score AS threshold, tp / (tp + fp) AS "precision", tp / p AS recall FROM totals
        UNION ALL SELECT 0, NULL, 1, 0""",
}


# Which earlier pieces each piece reads.
NEEDS = {
    "fact_activity": ["daily"], "rollup": ["dim_users", "fact_activity", "fact_engagement"],
    "base": ["rollup"], "realistic": ["rollup"], "derived": ["base"], "imputed": ["realistic"],
    "safe": ["imputed"], "leaking": ["safe"], "spine": ["rollup"], "dense": ["spine", "daily"], "series": ["dense"],
    "features": ["series"], "targets": ["series"], "trend": ["features"],
    "scored": ["trend", "realistic"], "forecast": ["scored"], "risk": ["forecast"], "live": ["risk"],
    "scores": ["rollup", "realistic"], "by_score": ["scores"], "totals": ["by_score"],
    "roc": ["totals"], "pr": ["totals"],
}


def sql(body: str, *pieces: str) -> str:
    wanted: set[str] = set()

    def visit(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for needed in NEEDS.get(name, []):
                visit(needed)

    for name in pieces:
        visit(name)
    parts = [f"{name} AS ({text})" for name, text in PIECES.items() if name in wanted]
    return f"WITH {', '.join(parts)} {body}"


DOUBLES = {
    "avg_session_duration", "avg_engagement", "quiz_accuracy", "challenge_completion", "engagement_score",
    "quiz_accuracy_percentage", "challenge_completion_rate",
}


def columns(names: list[str], doubles: set[str] = DOUBLES) -> str:
    return ", ".join(r(n) if n in doubles else n for n in names)


def distribution(column: str, table: str, piece: str) -> str:
    return sql(
        f"SELECT {column}, users, {r('100.0::DOUBLE * users / sum(users) OVER ()', 'percentage')}"
        f" FROM (SELECT {column}, count(*) AS users FROM {table} GROUP BY 1)", piece,
    )


def correlation(names: list[str], table: str) -> str:
    one = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN stddev_pop({c}) * stddev_pop(churned) >= 1e-12 THEN"
        f" covar_pop({c}, churned) / (stddev_pop({c}) * stddev_pop(churned)) END AS c FROM {table}"
        for c in names
    )
    return f"SELECT feature, {r('c', 'correlation')} FROM ({one})"


RISK_COLUMNS = [
    "user_key", "user_id", "current_churned_status", "days", "risk_sum", "risk_max", "days_high_risk",
    "avg_engagement", "engagement_trend", "low_activity_days", "low_quiz_days", "avg_churn_risk", "max_churn_risk",
]
RISK_DOUBLES = {"avg_engagement", "engagement_trend", "avg_churn_risk", "max_churn_risk"}
PROFILED = [
    c for c in BASE_COLUMNS
    if c not in ("user_id", "email", "last_activity_date", "account_status", "is_verified")
] + ["session_frequency", "quiz_completion_rate", "quiz_abandon_rate", "engagement_trend", "activity_diversity",
     "challenge_success_ratio", "consistency_index"]
NULL_CHECKED = [c for c in REALISTIC_COLUMNS if c != "email"]
FORECAST_DOUBLES = {f"predicted_{m}" for m in METRICS} | {"predicted_churn_risk"}
HIGH = f"SELECT user_key, user_id, {r('avg_churn_risk')} FROM risk WHERE exact_mean > 0.6"
BAND_SQL = " UNION ALL ".join(
    f"SELECT '{b}' AS band, count(*) FILTER ({c}) AS users, 100.0::DOUBLE * count(*) FILTER ({c}) / count(*) AS pct FROM risk"
    for b, c in {
        "low": "exact_mean > 0 AND exact_mean <= 0.3", "medium": "exact_mean > 0.3 AND exact_mean <= 0.6",
        "high": "exact_mean > 0.6",
    }.items()
)
EXPORT = ["user_id", "current_churned_status", "avg_churn_risk", "max_churn_risk", "days_high_risk",
          "avg_engagement", "engagement_trend"]
JOINED = "array_to_string(recommendations, ',') AS recommendations"
USER_JSON = ", ".join([
    "user_key := user_key", "user_id := user_id", "age := age", "last_activity_date := last_activity_date",
    "total_sessions := total_sessions", "avg_engagement := round(avg_engagement + 1e-11::DOUBLE, 8)", "is_verified := is_verified",
    "churned := churned",
])
FLIPPED = """SELECT user_key, CASE WHEN {condition} THEN 1 - churned ELSE churned END AS churned FROM (
    SELECT user_key, churned, {draw} AS d, row_number() OVER (ORDER BY {draw}, user_key) AS place,
        count(*) OVER () AS n FROM base)"""
TESTED = """SELECT user_key, churned, {condition} AS is_test FROM (
    SELECT user_key, churned_realistic AS churned, {draw} AS d,
        row_number() OVER (PARTITION BY churned_realistic ORDER BY {draw}, user_key) AS place,
        count(*) OVER (PARTITION BY churned_realistic) AS n FROM realistic)"""
FLIP_DRAW, SPLIT_DRAW = u("user_key", f"flip:{SEED}"), u("user_key", f"split:{SEED}")

FOREST_ROWS = sql(
    """SELECT user_key, 15::BIGINT AS days, 1 AS first_day, 15 AS last_day, true AS in_range FROM rollup""", "rollup")


def noisy_column(c: str) -> str:
    value = f"greatest(0.0, {c} + 0.1::DOUBLE * stddev_samp({c}) OVER () * {z('user_key', f'noise:{c}:{SEED}')})"
    return r(f"least(100.0, {value})" if c in PERCENTAGES else value, c)


def scaled(expression) -> str:
    return ", ".join(r(expression(m), m) for m in METRICS)


ORACLES = {
    "sql_sessions_by_status": sql(
        f"""SELECT u.account_status, count(DISTINCT u.user_key) AS users, sum(a.session_count)::BIGINT AS sessions,
        {r('avg(a.avg_session_duration)', 'mean_duration')}
        FROM dim_users u LEFT JOIN fact_activity a ON u.user_key = a.user_key GROUP BY 1""",
        "dim_users", "fact_activity"),
    "scan_users": sql("SELECT * FROM dim_users", "dim_users"),
    "scan_activity": sql(
        f"SELECT * EXCLUDE (avg_session_duration), {r('avg_session_duration')} FROM fact_activity", "fact_activity"),
    "scan_engagement": sql(
        "SELECT " + columns(["user_key", "engagement_score", "days_since_last_login", "current_streak",
                             "longest_streak", "quiz_accuracy_percentage", "challenge_completion_rate",
                             "stagnation_days"]) + " FROM fact_engagement", "fact_engagement"),
    "user_features_base": sql(
        "SELECT " + columns([c for c in BASE_COLUMNS if c != "email"]) + " FROM base", "base"),
    "user_features_realistic": sql(
        "SELECT " + columns([c for c in REALISTIC_COLUMNS if c != "email"]) + " FROM realistic", "realistic"),
    "derived_features": sql(
        "SELECT user_key, activity_diversity, " + ", ".join(r(c) for c in [
            "session_frequency", "quiz_completion_rate", "quiz_abandon_rate", "engagement_trend",
            "challenge_success_ratio", "consistency_index"]) + " FROM derived", "derived"),
    "imputed_safe_features": sql(
        "SELECT user_key, churned, " + columns(SAFE_FEATURES, set(MEDIAN_FILLED) | {
            "quiz_success_rate", "quiz_abandon_rate", "activity_per_session", "quiz_efficiency"}) + " FROM safe",
        "safe"),
    "noisy_features": sql(
        "SELECT user_key, " + ", ".join(noisy_column(c) for c in PERCENTAGES + FLOORED) + " FROM base", "base"),
    "flipped_labels": sql(FLIPPED.format(condition="place <= floor(n * 0.05::DOUBLE)", draw=FLIP_DRAW), "base"),
    "flipped_labels_approx": sql(FLIPPED.format(condition="d < 0.05", draw=FLIP_DRAW), "base"),
    "chosen_labels": sql(
        "SELECT user_key, churned_realistic AS churned, 'realistic' AS approach FROM realistic", "realistic"),
    "churn_label_counts": distribution("churned", "base", "base"),
    "churn_rate": sql(
        f"""SELECT count(*) AS total_records, sum(churned)::BIGINT AS positives,
        {r('100 * avg(churned)', 'churn_rate')} FROM base""", "base"),
    "risk_category_counts": distribution("risk_category", "realistic", "realistic"),
    "null_counts": sql(" UNION ALL ".join(
        f"SELECT '{'churned' if c == 'churned_realistic' else c}' AS column_name, count(*) - count({c}) AS nulls"
        " FROM realistic" for c in NULL_CHECKED), "realistic"),
    "numeric_profile": sql(" UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, {r(f'avg({c})', 'mean')},
        {r(f'stddev_samp({c})', 'std')}, {r(f'min({c})', 'min')}, {r(f'quantile_cont({c}, 0.25)', 'p25')},
        {r(f'quantile_cont({c}, 0.5)', 'p50')}, {r(f'quantile_cont({c}, 0.75)', 'p75')},
        {r(f'max({c})', 'max')} FROM derived""" for c in PROFILED), "derived"),
    "label_correlations": sql(correlation(SAFE_FEATURES, "safe"), "safe"),
    "label_correlations_top": sql(
        correlation(SAFE_FEATURES, "safe") + " ORDER BY abs(c) DESC NULLS LAST, feature LIMIT 10", "safe"),
    "screened_features": sql(
        f"SELECT *, NOT coalesce(abs(correlation) > 0.7, false) AS kept FROM ({correlation(SAFE_FEATURES, 'safe')})",
        "safe"),
    "stratified_test_rows": sql(
        TESTED.format(condition="place <= floor(n * 0.2::DOUBLE + 0.5)", draw=SPLIT_DRAW), "realistic"),
    "stratified_test_rows_approx": sql(TESTED.format(condition="d < 0.2", draw=SPLIT_DRAW), "realistic"),
    "ordered_split": sql(
        """SELECT user_key, CASE WHEN row_number() OVER (ORDER BY user_key)
            <= greatest(1, floor(0.8::DOUBLE * count(*) OVER ())) THEN 'train' ELSE 'validation' END AS part
        FROM rollup""", "rollup"),
    "ordered_split_from_states": sql("SELECT count(*) AS n_rows, true AS within_bound FROM rollup", "rollup"),
    "stratified_folds": sql(
        f"""SELECT user_key, churned_realistic AS churned, (ntile(5) OVER (PARTITION BY churned_realistic
            ORDER BY {u('user_key', f'fold:{SEED}')}, user_key) - 1)::INT AS fold FROM realistic""", "realistic"),
    "standardised_features": sql("SELECT user_key, " + ", ".join(
        r(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)", c)
        for c in SAFE_FEATURES) + " FROM safe", "safe"),
    "min_max_targets": sql("SELECT user_key, horizon_day, " + scaled(
        lambda m: f"({m} - min({m}) OVER ()) / coalesce(nullif(max({m}) OVER () - min({m}) OVER (), 0), 1)")
        + " FROM targets", "targets"),
    "min_max_round_trip": sql(
        "SELECT user_key, horizon_day, " + scaled(lambda m: m) + " FROM targets", "targets"),
    "daily_series": sql("SELECT user_key, day_offset, " + scaled(lambda m: m) + " FROM series", "series"),
    "series_features": sql("SELECT user_key, " + ", ".join(r(c) for c in FEATURES) + " FROM features", "features"),
    "series_targets": sql(" UNION ALL ".join(
        f"SELECT user_key, horizon_day, '{m}' AS metric, {r(m, 'y')} FROM targets" for m in METRICS), "targets"),
    "widened_targets": sql("SELECT user_key, horizon_day, " + scaled(lambda m: m) + " FROM targets", "targets"),
    "trend_forecast": sql("SELECT " + columns(
        ["user_id", "user_key", "prediction_day", "predicted_date", "current_churned_status",
         *[f"predicted_{m}" for m in METRICS], "risk_tenths", "predicted_churn_risk",
         "predicted_engagement_level"], FORECAST_DOUBLES) + " FROM forecast", "forecast"),
    "trend_forecast_error": sql(
        f"SELECT {r('avg(abs(y - p))', 'mae')}, {r('avg((y - p) * (y - p))', 'mse')}, count(*) AS cells FROM ("
        + " UNION ALL ".join(
            f"SELECT a.{m} AS y, t.{m} AS p FROM targets a JOIN trend t USING (user_key, horizon_day)"
            for m in METRICS) + ")", "targets", "trend"),
    "forecast_totals": sql(
        """SELECT count(DISTINCT user_key) AS users_analyzed, max(prediction_day)::BIGINT AS prediction_days,
        count(*) AS total_predictions, 9::BIGINT AS metrics_per_day,
        (count(*) // count(DISTINCT user_key))::BIGINT AS predictions_per_user FROM forecast""", "forecast"),
    "user_risk": sql("SELECT " + columns(RISK_COLUMNS, RISK_DOUBLES) + " FROM risk", "risk"),
    "high_risk_users": sql(HIGH, "risk"),
    "high_risk_users_top20": sql(f"{HIGH} ORDER BY exact_mean DESC, user_key LIMIT 20", "risk"),
    "high_risk_total": sql("SELECT count(*) AS total_high_risk FROM risk WHERE exact_mean > 0.6", "risk"),
    "users_by_status": sql(
        """SELECT user_key, CASE current_churned_status WHEN 0 THEN 'active' ELSE 'churned' END AS status_group
        FROM risk""", "risk"),
    "status_counts": sql(
        "SELECT current_churned_status, count(DISTINCT user_id) AS users FROM risk GROUP BY 1", "risk"),
    "risk_bands": sql(f"SELECT band, users, {r('pct', 'percentage')} FROM ({BAND_SQL})", "risk"),
    "risk_summary": sql(
        f"""SELECT count(*) AS total_users, {r('avg(avg_churn_risk)', 'average_risk')},
        count(*) FILTER (exact_mean <= 0.3) AS low_users,
        count(*) FILTER (exact_mean > 0.3 AND exact_mean <= 0.6) AS medium_users,
        count(*) FILTER (exact_mean > 0.6) AS high_users,
        count(*) FILTER (current_churned_status = 0) AS active_users,
        count(*) FILTER (current_churned_status = 1) AS churned_users,
        count(*) FILTER (exact_mean > 0.6) AS high_risk_users FROM risk""", "risk"),
    "recommendations_live": sql(f"SELECT user_key, {r('avg_churn_risk')}, {JOINED} FROM live", "live"),
    "recommendations_classic": sql(
        f"SELECT user_key, array_to_string({ACTIONS_CLASSIC}, ',') AS recommendations FROM risk", "risk"),
    "top_actions": sql(
        """SELECT action, count(*) AS users FROM (SELECT unnest(recommendations) AS action FROM live)
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "live"),
    "recommendations_top20": sql(
        f"""SELECT {columns(EXPORT, RISK_DOUBLES).replace('days_high_risk', 'days_high_risk::INT AS days_high_risk')},
        {JOINED} FROM live ORDER BY exact_mean DESC, user_key LIMIT 20""", "live"),
    "recommendations_csv": sql(
        f"SELECT {columns(EXPORT, RISK_DOUBLES)}, len(recommendations)::INT AS total_recommendations, "
        + ", ".join(f"recommendations[{i}] AS recommendation_{i}" for i in range(1, 6)) + " FROM live", "live"),
    "roc_curve": sql(f"SELECT {r('threshold')}, {r('fpr')}, {r('tpr')} FROM roc", "roc"),
    "roc_curve_corners": sql(
        f"""SELECT {r('threshold')}, {r('fpr')}, {r('tpr')} FROM roc WHERE place <= 1 OR place IN (
        SELECT place FROM totals WHERE next_pos IS NULL OR next_pos <> pos OR next_neg <> neg)""", "roc"),
    "precision_recall_curve": sql(
        f"SELECT {r('threshold')}, {r('''\"precision\"''')}, {r('recall')} FROM pr", "pr"),
    "curve_areas": sql(
        f"""SELECT {r('sum((fpr - f0) * (tpr + t0) / 2)', 'roc_auc')},
        (SELECT {r('sum((recall - r0) * (pc + p0) / 2)', 'pr_auc')} FROM (
            SELECT recall, "precision" AS pc, lag(recall) OVER (ORDER BY place) AS r0,
                lag("precision") OVER (ORDER BY place) AS p0 FROM pr)) AS pr_auc
        FROM (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY place) AS f0, lag(tpr) OVER (ORDER BY place) AS t0 FROM roc)""",
        "roc", "pr"),
    "score_stats": sql(
        f"""SELECT {r('min(score)', 'min')}, {r('max(score)', 'max')}, {r('avg(score)', 'mean')},
        {r('stddev_pop(score)', 'std')}, {r('median(score)', 'median')} FROM scores""", "scores"),
    "score_overlap": sql(
        f"""SELECT {r('avg((score BETWEEN low AND high)::INT)', 'overlap_ratio')} FROM scores,
        (SELECT min(score) AS low, max(score) AS high FROM scores WHERE churned = 1) WHERE churned = 0""", "scores"),
    "extreme_scores": sql(
        f"""SELECT count(*) FILTER (score > 0.95) AS high, count(*) FILTER (score < 0.05) AS low, count(*) AS total,
        {r('100.0::DOUBLE * count(*) FILTER (score > 0.95) / count(*)', 'high_percentage')},
        {r('100.0::DOUBLE * count(*) FILTER (score < 0.05) / count(*)', 'low_percentage')} FROM scores""", "scores"),
    "class_weights": sql(
        f"""SELECT churned_realistic AS churned, count(*) AS users,
        {r('sum(count(*)) OVER () / (2.0::DOUBLE * count(*))', 'weight')} FROM realistic GROUP BY 1""", "realistic"),
    "first_forecasts": sql(
        f"""SELECT user_key, prediction_day, {r('predicted_churn_risk')}, predicted_engagement_level FROM forecast
        ORDER BY user_key, prediction_day LIMIT 100""", "forecast"),
    "chart_forecast_lines": sql(
        f"""SELECT user_key, user_id, prediction_day, {r('predicted_churn_risk')}, {r('predicted_engagement_score')},
        {r('predicted_sessions_count')}, {r('predicted_quiz_attempts')} FROM forecast
        WHERE user_key IN (SELECT DISTINCT user_key FROM forecast ORDER BY 1 LIMIT 5)""", "forecast"),
    "detailed_users": sql(
        f"""SELECT row_number() OVER (ORDER BY exact_mean DESC, user_key)::INT AS "rank", user_id,
        CASE WHEN current_churned_status = 1 THEN 'churned' ELSE 'active' END AS status_text,
        current_churned_status AS status_code, days_high_risk, {', '.join(r(c) for c in sorted(RISK_DOUBLES))},
        printf('%+.1f', engagement_trend) AS engagement_trend_formatted, {JOINED}
        FROM live ORDER BY exact_mean DESC, user_key LIMIT 5""", "live"),
    "user_json_rows": sql(f"SELECT to_json(struct_pack({USER_JSON}))::VARCHAR AS json FROM base", "base"),
    "label_count_map": sql(
        """SELECT '{' || string_agg('"' || churned || '":' || users, ',' ORDER BY churned) || '}' AS stats
        FROM (SELECT churned, count(*) AS users FROM base GROUP BY 1)""", "base"),
    "heuristic_risk": sql(
        f"""SELECT user_key, user_id, {r('0.3::DOUBLE + days_since_last_login / 30.0::DOUBLE * 0.4::DOUBLE'
        ' + (100 - avg_engagement) / 100 * 0.3::DOUBLE', 'risk_score')} FROM rollup WHERE days_since_last_login > 7""", "rollup"),
    "sampled_users": sql(
        f"SELECT user_key FROM rollup ORDER BY {u('user_key', f'sample:{SEED}')}, user_key LIMIT 50", "rollup"),
    "recommendations_tiers": sql(
        f"SELECT user_key, array_to_string({tier(BY_TIER, 'exact_mean')}, ',') AS recommendations FROM risk", "risk"),
    "forecaster_split": sql(
        """SELECT greatest(1, floor(0.8::DOUBLE * count(*)))::BIGINT AS train_users,
        count(*) - greatest(1, floor(0.8::DOUBLE * count(*)))::BIGINT AS validation_users FROM rollup""", "rollup"),
    "screened_leak": sql(f"""SELECT feature FROM ({correlation([*SAFE_FEATURES, 'leak'], 'leaking')})
        WHERE NOT coalesce(abs(correlation) > 0.7, false)""", "leaking"),
    "score_diagnosis": sql(
        f"""SELECT *, {r('100.0::DOUBLE * high / total', 'high_percentage')}, {r('100.0::DOUBLE * low / total', 'low_percentage')} FROM (
        SELECT {r('min(score)', 'min')}, {r('max(score)', 'max')}, {r('avg(score)', 'mean')}, {r('stddev_pop(score)', 'std')},
            {r('median(score)', 'median')},
            {r('avg((score BETWEEN low1 AND high1)::INT) FILTER (churned = 0)', 'overlap_ratio')},
            count(*) FILTER (score > 0.95) AS high, count(*) FILTER (score < 0.05) AS low, count(*) AS total
        FROM scores, (SELECT min(score) AS low1, max(score) AS high1 FROM scores WHERE churned = 1))""", "scores"),
    "classifier_scores": sql(
        f"""SELECT user_key, churned, true AS in_range, true AS consistent
        FROM ({TESTED.format(condition='place <= floor(n * 0.2::DOUBLE + 0.5)', draw=SPLIT_DRAW)}) WHERE is_test""", "realistic"),
    "classifier_importances": sql(
        f"""SELECT count(*) AS features, count(*) AS names, 1.0::DOUBLE AS total, true AS none_negative
        FROM ({correlation(SAFE_FEATURES, 'safe')}) WHERE NOT coalesce(abs(correlation) > 0.7, false)""", "safe"),
    "classifier_cross_validation": sql(
        "SELECT count(*) AS users, true AS mean_in_range, true AS spread_not_negative FROM realistic", "realistic"),
    "forest_forecast": FOREST_ROWS,
    "forest_forecast_per_metric": FOREST_ROWS,
    "loaded_model_forecast": FOREST_ROWS,
    "stored_model_risk": sql(
        "SELECT user_key, user_id, true AS mean_agrees, true AS max_agrees, true AS listed_if_high, true AS has_actions FROM rollup", "rollup"),
    "stored_model_report": sql(
        "SELECT 5::BIGINT AS users_in_report, count(*) AS total_users, 15 * count(*) AS total_predictions, true AS bands_fit FROM rollup", "rollup"),
    "stored_model_charts": sql(
        f"""SELECT 'future_predictions' AS chart, 15 * least(5, count(*)) AS points FROM rollup
        UNION ALL SELECT 'churn_distribution', count(DISTINCT churned_realistic) FROM realistic
        UNION ALL SELECT 'correlations', least(15, count(*)) FROM ({correlation(SAFE_FEATURES, 'safe')})
        UNION ALL SELECT 'feature_importance', least(10, count(*)) FROM ({correlation(SAFE_FEATURES, 'safe')}) WHERE NOT coalesce(abs(correlation) > 0.7, false)
        UNION ALL SELECT 'risk_distribution', 3 UNION ALL SELECT 'curve_areas', 1""", "rollup", "realistic", "safe"),
    "stored_model_importances": sql(
        f"""SELECT least(10, count(*)) AS shown, true AS falling, true AS in_range, true AS known
        FROM ({correlation(SAFE_FEATURES, 'safe')}) WHERE NOT coalesce(abs(correlation) > 0.7, false)""", "safe"),
    "full_analysis_summary": sql(
        """SELECT count(*) AS total_users_analyzed, count(*) AS users_by_status, true AS bands_fit, 15 AS prediction_days,
        15 * count(*) AS total_predictions, true AS auc_in_range, true AS error_not_negative,
        15 * 9 * (count(*) - greatest(1, floor(0.8::DOUBLE * count(*)))::BIGINT) AS validation_cells FROM rollup""", "rollup"),
    "detailed_report_json": sql(
        """SELECT 5::BIGINT AS users_in_report, '2024-01-31' AS generated_at, count(*) AS total_users,
        count(*) FILTER (exact_mean > 0 AND exact_mean <= 0.3) AS low_users, count(*) FILTER (exact_mean > 0.6) AS high_users,
        15 * count(*) AS total_predictions,
        (SELECT user_id FROM live ORDER BY exact_mean DESC, user_key LIMIT 1) AS first_user,
        (SELECT user_id FROM live ORDER BY exact_mean DESC, user_key LIMIT 1 OFFSET 4) AS fifth_user,
        (SELECT recommendations[1] FROM live ORDER BY exact_mean DESC, user_key LIMIT 1) AS first_action FROM live""", "live"),
}
ORACLES["user_rollup_corrected"] = sql(
    "SELECT " + columns(["user_key", "user_id", "age", "account_status", "is_verified", "registration_date",
                         "last_activity_date", "avg_session_duration", "total_sessions", "avg_engagement",
                         "days_since_last_login", "current_streak", "longest_streak", "quiz_accuracy",
                         "challenge_completion", "stagnation_days", "total_quiz_attempts", "total_quiz_completions",
                         "total_quiz_abandons", "total_content_views", "total_challenge_interactions"])
    + f""" FROM ({rollup_sql('''(SELECT user_key, avg(engagement_score) AS engagement_score,
        max(days_since_last_login) AS days_since_last_login, max(current_streak) AS current_streak,
        max(longest_streak) AS longest_streak, avg(quiz_accuracy_percentage) AS quiz_accuracy_percentage,
        avg(challenge_completion_rate) AS challenge_completion_rate, max(stagnation_days) AS stagnation_days
        FROM fact_engagement GROUP BY user_key)''')})""",
    "dim_users", "fact_activity", "fact_engagement")
ORACLES["user_rollup_incremental"] = ORACLES["user_rollup_bucketed"] = ORACLES["user_rollup_corrected"]
ORACLES["daily_series_bucketed"] = ORACLES["daily_series"]
ORACLES["curve_area_bounds"] = sql(
    f"""SELECT {r('(apart + together / 2.0::DOUBLE) / every', 'area')}, {r('together / 2.0::DOUBLE / every', 'error')}, true AS within FROM (
    SELECT sum(positives * below) AS apart, sum(positives * negatives) AS together, sum(positives) * sum(negatives) AS every FROM (
        SELECT *, coalesce(sum(negatives) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
            SELECT least(floor(score * 1000), 999) AS bin, count(*) FILTER (churned = 1) AS positives, count(*) FILTER (churned <> 1) AS negatives
            FROM scores GROUP BY 1)))""", "scores")
ORACLES["distinct_active_users"] = sql(
    """SELECT CAST(date_trunc('month', last_activity_date) AS DATE) AS month, count(DISTINCT user_key) AS users FROM fact_activity GROUP BY 1
    UNION ALL SELECT NULL, count(DISTINCT user_key) FROM fact_activity""", "fact_activity")
ORACLES["tier_risk_days"] = sql(
    f"""SELECT user_key, d AS days_high_risk, {r('max_churn_risk')}, array_to_string({tier(BY_TIER, 'exact_mean')}, ',') AS recommendations
    FROM risk JOIN (SELECT user_key, count(*) FILTER (risk_tenths > 6) AS d FROM forecast GROUP BY user_key) USING (user_key)""", "risk", "forecast")
