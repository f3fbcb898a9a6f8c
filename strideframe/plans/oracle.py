"""DuckDB twins of the registered queries.

Windows, correlated subqueries and joins where they read naturally in SQL.
The change list's SQL (``_apply_sql``) follows the same definition as the Spark
fold; the check that shares nothing with it is the one-by-one property test.  Base tables are the driver's views; the fixture views
are CTEs defined once below.
"""

from __future__ import annotations

from .tree_oracle import scored_ctes, tree_ctes

NOW = "TIMESTAMP '2025-01-01 00:00:00'"

# Fixture views, in dependency order.
_VIEWS: dict[str, str] = {}
_VIEWS["users"] = """
SELECT c.c_custkey AS id,
       lower(replace(c.c_name, '#', '.')) || '@example.com' AS email,
       c.c_acctbal >= 0 AS is_active,
       CAST(18 + c.c_custkey % 60 AS INTEGER) AS age,
       CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'gain_muscle' WHEN 'BUILDING' THEN 'lose_weight'
            WHEN 'FURNITURE' THEN 'endurance' WHEN 'HOUSEHOLD' THEN 'flexibility'
            WHEN 'MACHINERY' THEN 'general_fitness' END AS goal,
       CASE r.r_name WHEN 'AFRICA' THEN 'full_gym' WHEN 'AMERICA' THEN 'home_gym' WHEN 'ASIA' THEN 'yoga_mat'
            WHEN 'EUROPE' THEN 'none' WHEN 'MIDDLE EAST' THEN 'kettlebell' END AS equipment,
       TIMESTAMP '2024-01-01 00:00:00' AS created_at,
       TIMESTAMP '2024-01-01 00:00:00' AS updated_at
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey"""
_VIEWS["logs"] = """
SELECT event_id AS id, user_id, CAST(ts AS DATE) AS workout_date,
       TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS duration_min,
       CASE WHEN value < 10 THEN 'very_low' WHEN value < 30 THEN 'low' WHEN value < 80 THEN 'moderate'
            ELSE 'high' END AS intensity,
       CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'yoga' WHEN 'purchase' THEN 'deadlift'
            WHEN 'signup' THEN 'cycling' WHEN 'error' THEN 'bench_press' ELSE 'other' END AS workout_type,
       value AS calories_burned, ts AS created_at, ts AS updated_at
FROM events"""
_VIEWS["training"] = """
SELECT l.id, l.user_id, l.workout_type, u.equipment, l.intensity, l.duration_min, l.calories_burned, u.goal
FROM logs l JOIN users u ON u.id = l.user_id"""
_VIEWS["new_logs"] = """
SELECT id AS seq, user_id,
       CASE WHEN id % 13 = 5 THEN '2025-13-01' ELSE strftime(workout_date, '%Y-%m-%d') END AS workout_date,
       CASE WHEN id % 19 = 4 THEN 0 ELSE duration_min END AS duration_min,
       intensity, workout_type,
       CASE WHEN id % 23 = 6 THEN 0.0 ELSE calories_burned END AS calories_burned
FROM logs"""
_VIEWS["patches"] = """
SELECT id AS seq, id, CASE WHEN id % 30 = 0 THEN user_id + 1 ELSE user_id END AS user_id,
       '{"duration_min": ' || CAST(duration_min + 1 AS VARCHAR)
       || CASE WHEN id % 50 = 10 THEN ', "intensity": null' WHEN id % 20 = 0 THEN ', "intensity": "high"' ELSE '' END
       || CASE WHEN id % 70 = 0 THEN ', "equipment_used": "mat"' ELSE '' END || '}' AS body
FROM logs"""
_VIEWS["deletes"] = """
SELECT id AS seq, id, CASE WHEN id % 3 = 0 THEN user_id + 1 ELSE user_id END AS user_id
FROM logs"""
# Creates carry typed fields (c_*) instead of a JSON body.
_NO_CREATE = ("NULL::VARCHAR AS c_date, NULL::INTEGER AS c_duration, NULL::VARCHAR AS c_intensity, "
              "NULL::VARCHAR AS c_type, NULL::DOUBLE AS c_calories")
_CREATE = ("strftime(workout_date, '%Y-%m-%d') AS c_date, duration_min + 1 AS c_duration, "
           "intensity AS c_intensity, workout_type AS c_type, calories_burned AS c_calories")
_VIEWS["changes"] = f"""
SELECT id * 8 AS seq, 'patch' AS op, id, user_id,
       '{{"duration_min": ' || CAST(duration_min + 5 AS VARCHAR) || ', "workout_type": "yoga"}}' AS body, {_NO_CREATE}
FROM logs
UNION ALL
SELECT id * 8 + 1, 'delete', id, CASE WHEN id % 45 = 0 THEN user_id + 1 ELSE user_id END, NULL, {_NO_CREATE}
FROM logs WHERE id % 15 = 0
UNION ALL
SELECT id * 8 + 2, 'patch', id, user_id,
       CASE WHEN id % 25 = 0 THEN '{{"intensity": null}}'
            ELSE '{{"intensity": "low", "workout_type": "running"}}' END, {_NO_CREATE}
FROM logs
UNION ALL
SELECT id * 8 + 3, 'create', -id, user_id, NULL, {_CREATE} FROM logs WHERE id % 20 = 0
UNION ALL
SELECT id * 8 + 3, CASE WHEN id % 20 = 1 THEN 'merge' END, id, user_id, NULL, {_NO_CREATE} FROM logs WHERE id % 20 IN (1, 2)
UNION ALL  -- creates whose bodies hold a wrong type: no field can be read
SELECT id * 8 + 3, 'create', -id, user_id, NULL, {_NO_CREATE} FROM logs WHERE id % 20 BETWEEN 3 AND 9
UNION ALL
SELECT id * 8 + 4, 'create', id, user_id, NULL, {_CREATE} FROM logs WHERE id % 60 = 0
UNION ALL
SELECT id * 8 + 5, 'patch', -id, user_id, '{{"duration_min": ' || CAST(duration_min + 9 AS VARCHAR) || '}}',
       {_NO_CREATE}
FROM logs WHERE id % 20 = 0
UNION ALL
SELECT id * 8 + 6, 'delete', -id, user_id, NULL, {_NO_CREATE} FROM logs WHERE id % 40 = 0
UNION ALL
SELECT id * 8 + 7, 'patch', -id, user_id, '{{"intensity": "high"}}', {_NO_CREATE}
FROM logs WHERE id % 40 = 0"""
_VIEWS["new_users"] = """
SELECT id AS seq,
       CASE WHEN id % 25 = 0 THEN email
            WHEN id % 25 = 7 THEN repeat('a', 250) || '@example.org'
            WHEN id % 5 = 1 THEN 'new.' || CAST(id % 97 AS VARCHAR) || '@EXAMPLE.com'
            ELSE 'member.' || CAST(id AS VARCHAR) || '@Example.Org' END AS email,
       CASE WHEN id % 25 <> 0 AND id % 5 = 1 AND id % 7 = 3 THEN 17 ELSE age END AS age,
       goal, equipment
FROM users"""
_VIEWS["issues"] = "SELECT user_id, ts AS issued_at FROM events WHERE event_type = 'signup'"
_VIEWS["requests"] = """
SELECT event_id AS request_id, CASE WHEN event_id % 25 = 0 THEN NULL ELSE user_id END AS user_id, ts
FROM events WHERE event_type <> 'signup'"""
_VIEWS["logins"] = """
SELECT id AS attempt_id, CASE WHEN id % 11 = 0 THEN 'nobody@example.com' ELSE email END AS email,
       id % 3 <> 0 AS password_ok
FROM users"""
_VIEWS["score_requests"] = """
SELECT l.id AS request_id,
       CASE WHEN l.id % 40 = 3 THEN 'HIIT' ELSE l.workout_type END AS workout_type,
       CASE WHEN l.id % 40 = 5 THEN NULL ELSE u.equipment END AS equipment,
       CASE WHEN l.id % 40 = 7 THEN 'extreme' ELSE l.intensity END AS intensity,
       l.duration_min, l.calories_burned
FROM logs l JOIN users u ON u.id = l.user_id"""

_DEPS = {
    "users": [], "logs": [], "training": ["users", "logs"], "new_logs": ["logs"],
    "patches": ["logs"], "deletes": ["logs"], "changes": ["logs"], "new_users": ["users"],
    "issues": [], "requests": [], "logins": ["users"], "score_requests": ["logs", "users"],
}


def with_views(*names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in _DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in order)


# ---------------------------------------------------------------------------
# Shared SQL pieces
# ---------------------------------------------------------------------------

def _auth(req: str, usr: str) -> str:
    return (f"CASE WHEN {req}.user_id IS NULL THEN 'unauthorized' WHEN {usr}.id IS NULL THEN 'unauthorized' "
            f"WHEN NOT {usr}.is_active THEN 'inactive' END")


def _user_errors(e: str = "email") -> str:
    return f"""concat_ws(',',
  CASE WHEN NOT coalesce(regexp_full_match({e}, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+'), false) THEN 'email_syntax' END,
  CASE WHEN length({e}) > 255 THEN 'email_len' END,
  CASE WHEN NOT coalesce(age BETWEEN 18 AND 120, false) THEN 'age_range' END,
  CASE WHEN NOT coalesce(goal IS NOT NULL AND length(goal) <= 50, false) THEN 'goal_len' END,
  CASE WHEN NOT coalesce(equipment IS NOT NULL AND length(equipment) <= 100, false) THEN 'equipment_len' END)"""


def _log_errors(d="workout_date", du="duration_min", i="intensity", t="workout_type", c="calories_burned") -> str:
    return f"""concat_ws(',',
  CASE WHEN try_strptime({d}, '%Y-%m-%d') IS NULL THEN 'date_parse' END,
  CASE WHEN NOT coalesce({du} > 0, false) THEN 'duration_positive' END,
  CASE WHEN NOT coalesce({i} IS NOT NULL AND length({i}) <= 50, false) THEN 'intensity_len' END,
  CASE WHEN NOT coalesce({t} IS NOT NULL AND length({t}) <= 50, false) THEN 'type_len' END,
  CASE WHEN NOT ({c} IS NULL OR {c} > 0) THEN 'calories_positive' END)"""


def _apply_sql(changes_cte: str, with_auth: bool) -> tuple[str, str]:
    """(outcomes SQL body, table SQL body) of an ordered change list.

    ``changes_cte`` names a CTE with seq, op, id, user_id, body, c_* columns.
    Semantics written directly: a request hits a log when the owner matches
    and it was born before; the first hitting delete kills it; the last
    accepted value per field wins.
    """
    auth = _auth("c", "u") if with_auth else "NULL::VARCHAR"
    join_users = "LEFT JOIN users u ON u.id = c.user_id" if with_auth else ""
    num_types = "('UBIGINT','BIGINT','DOUBLE','INTEGER','UINTEGER','HUGEINT')"

    def jt(f):
        return f"(CASE WHEN json_valid(body) THEN json_type(body, '$.{f}') END)"

    def js(f):
        return f"(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.{f}') END)"

    ctes = f"""
ch AS (SELECT c.*, {auth} AS auth FROM {changes_cte} c {join_users}),
cr AS (SELECT *, concat_ws(',', NULLIF({_log_errors('c_date', 'c_duration', 'c_intensity', 'c_type', 'c_calories')}, ''),
                          CASE WHEN id IS NULL THEN 'id_present' END) AS errs
       FROM ch WHERE op = 'create'),
cand AS (SELECT * FROM cr WHERE auth IS NULL AND errs = ''
         AND NOT EXISTS (SELECT 1 FROM logs l WHERE l.id = cr.id)),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM cand) WHERE rn = 1),
entity AS (
  SELECT id, user_id, workout_date, duration_min, intensity, workout_type, calories_burned,
         created_at, updated_at, NULL::BIGINT AS born FROM logs
  UNION ALL
  SELECT id, user_id, CAST(try_strptime(c_date, '%Y-%m-%d') AS DATE), c_duration, c_intensity, c_type,
         c_calories, {NOW}, {NOW}, seq FROM win),
pp AS (
  SELECT ch.seq, ch.op, ch.id, ch.user_id, ch.auth, ch.body,
         coalesce(json_valid(body) AND json_type(body) = 'OBJECT', false) AS body_ok,
         {jt('duration_min')} AS k_dur, {js('duration_min')} AS s_dur,
         {jt('intensity')} AS k_int, {js('intensity')} AS s_int,
         {jt('workout_type')} AS k_typ, {js('workout_type')} AS s_typ,
         {jt('equipment_used')} AS k_eq
  FROM ch WHERE op IN ('patch', 'delete')),
pv AS (
  SELECT *,
    CASE WHEN k_dur IN {num_types} AND TRY_CAST(s_dur AS DOUBLE) = floor(TRY_CAST(s_dur AS DOUBLE))
              AND abs(TRY_CAST(s_dur AS DOUBLE)) <= 2147483647 THEN CAST(TRY_CAST(s_dur AS DOUBLE) AS INTEGER)
         WHEN k_dur = 'VARCHAR' AND regexp_full_match(s_dur, '[+-]?[0-9]+')
              AND abs(TRY_CAST(s_dur AS DOUBLE)) <= 2147483647 THEN CAST(TRY_CAST(s_dur AS DOUBLE) AS INTEGER)
    END AS v_dur,
    CASE WHEN k_int = 'VARCHAR' THEN s_int END AS v_int,
    CASE WHEN k_typ = 'VARCHAR' THEN s_typ END AS v_typ
  FROM pp),
pi AS (
  SELECT *,
    op = 'patch' AND NOT (
      body_ok
      AND (k_dur IS NULL OR k_dur = 'NULL' OR v_dur IS NOT NULL)
      AND (k_int IS NULL OR k_int IN ('NULL', 'VARCHAR'))
      AND (k_typ IS NULL OR k_typ IN ('NULL', 'VARCHAR'))
      AND (k_eq IS NULL OR k_eq IN ('NULL', 'VARCHAR'))
      AND (k_dur IS NULL OR k_dur = 'NULL' OR v_dur > 0)) AS invalid
  FROM pv),
ph AS (
  SELECT pi.*, e.duration_min AS b_dur, e.intensity AS b_int, e.workout_type AS b_typ,
    coalesce(pi.auth IS NULL AND NOT pi.invalid AND e.user_id = pi.user_id
             AND (e.born IS NULL OR pi.seq > e.born), false) AS hit
  FROM pi LEFT JOIN entity e ON e.id = pi.id),
pd AS (
  SELECT *, min(CASE WHEN op = 'delete' AND hit THEN seq END) OVER (PARTITION BY id) AS dead FROM ph),
po AS (
  SELECT *,
    CASE WHEN auth IS NOT NULL THEN auth
         WHEN invalid THEN 'invalid'
         WHEN NOT (hit AND (dead IS NULL OR seq <= dead)) THEN 'not_found'
         WHEN op = 'delete' THEN 'deleted'
         WHEN k_dur = 'NULL' OR k_int = 'NULL' OR k_typ = 'NULL' THEN 'rejected_not_null'
         WHEN coalesce(length(v_int) > 50, false) OR coalesce(length(v_typ) > 50, false) THEN 'rejected_too_long'
         ELSE 'ok' END AS outcome
  FROM pd),
fold AS (
  SELECT id,
    arg_max(v_dur, seq) FILTER (WHERE k_dur IS NOT NULL) AS n_dur,
    arg_max(v_int, seq) FILTER (WHERE k_int IS NOT NULL) AS n_int,
    arg_max(v_typ, seq) FILTER (WHERE k_typ IS NOT NULL) AS n_typ,
    bool_or((k_dur IS NOT NULL AND v_dur IS DISTINCT FROM b_dur)
            OR (k_int IS NOT NULL AND v_int IS DISTINCT FROM b_int)
            OR (k_typ IS NOT NULL AND v_typ IS DISTINCT FROM b_typ)) AS changed
  FROM po WHERE op = 'patch' AND outcome = 'ok' GROUP BY id),
gone AS (SELECT DISTINCT id FROM pd WHERE dead IS NOT NULL),
outcomes AS (
  SELECT cr.seq, cr.op, cr.id, cr.user_id,
    CASE WHEN cr.auth IS NOT NULL THEN cr.auth WHEN cr.errs <> '' THEN 'invalid'
         WHEN w.seq IS NOT NULL THEN 'created' ELSE 'conflict' END AS outcome
  FROM cr LEFT JOIN win w ON w.seq = cr.seq
  UNION ALL
  SELECT seq, op, id, user_id, outcome FROM po
  UNION ALL
  SELECT seq, op, id, user_id, coalesce(auth, 'invalid') FROM ch
  WHERE op IS NULL OR op NOT IN ('create', 'patch', 'delete')),
result AS (
  SELECT e.id, e.user_id, e.workout_date,
    coalesce(f.n_dur, e.duration_min) AS duration_min,
    coalesce(f.n_int, e.intensity) AS intensity,
    coalesce(f.n_typ, e.workout_type) AS workout_type,
    e.calories_burned, e.created_at,
    CASE WHEN coalesce(f.changed, false) THEN {NOW} ELSE e.updated_at END AS updated_at
  FROM entity e LEFT JOIN fold f ON f.id = e.id
  WHERE e.id NOT IN (SELECT id FROM gone))"""
    return ctes, "SELECT seq, op, id, user_id, outcome FROM outcomes", \
        "SELECT * FROM result"


def _apply_query(views: list[str], changes_sql: str, with_auth: bool, want: str) -> str:
    ctes, outcomes, table = _apply_sql("chg", with_auth)
    head = with_views(*views)
    return f"{head},\nchg AS ({changes_sql}),{ctes}\n{outcomes if want == 'outcomes' else table}"


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------

ORACLE: dict[str, str] = {}

ORACLE["user_lookup_by_id"] = with_views("users", "requests") + """
SELECT r.request_id, u.id, u.email, u.is_active, u.age, u.goal, u.equipment, u.created_at
FROM requests r JOIN users u ON u.id = r.user_id"""

ORACLE["user_lookup_by_email"] = with_views("users", "logins") + """
SELECT l.attempt_id, u.email, u.id, u.is_active, u.age, u.goal, u.equipment, u.created_at
FROM logins l JOIN users u ON u.email = l.email"""

ORACLE["owner_log_lookup"] = with_views("logs", "patches") + """
SELECT p.seq AS request_id, p.id, p.user_id,
       CASE WHEN l.id IS NULL THEN 'not_found' ELSE 'ok' END AS outcome,
       l.workout_date, l.duration_min, l.intensity, l.workout_type, l.calories_burned, l.created_at, l.updated_at
FROM patches p LEFT JOIN logs l ON l.id = p.id AND l.user_id = p.user_id"""

ORACLE["user_history"] = with_views("users", "logs") + """
SELECT l.*, CAST(row_number() OVER (PARTITION BY l.user_id ORDER BY l.created_at DESC, l.id DESC) AS BIGINT) AS rank
FROM logs l WHERE l.user_id IN (SELECT id FROM users WHERE is_active)"""

ORACLE["public_users"] = with_views("users") + """
SELECT id, email, is_active, age, goal, equipment, created_at FROM users"""

ORACLE["log_view"] = with_views("logs") + "\nSELECT * FROM logs"

ORACLE["ordinal_intensity"] = with_views("score_requests") + """
SELECT request_id, intensity,
       CASE intensity WHEN 'very_low' THEN 1 WHEN 'low' THEN 2 WHEN 'moderate' THEN 3 WHEN 'high' THEN 4 END
       AS intensity_numeric
FROM score_requests"""

ORACLE["result_line"] = with_views("training") + """
SELECT id, 'Input: ' || workout_type || ', ' || equipment || ' -> Predicted Goal: ' || goal AS result FROM training"""

_TITLE = ("array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), "
          "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")
ORACLE["display_label"] = with_views("training") + f"""
SELECT id, {_TITLE.format(c='workout_type')} AS workout_label, {_TITLE.format(c='equipment')} AS equipment_label,
       {_TITLE.format(c='goal')} AS goal_label
FROM training"""

_ACCEPTED = ("coalesce(workout_type IN ('deadlift', 'running', 'bench_press', 'yoga', 'cycling') "
             "AND equipment IN ('full_gym', 'home_gym', 'yoga_mat', 'none') "
             "AND intensity IN ('very_low', 'low', 'moderate', 'high'), false)")
ORACLE["scoring_domain_split"] = with_views("score_requests") + f"""
SELECT request_id, {_ACCEPTED} AS accepted,
       CASE WHEN NOT {_ACCEPTED} THEN 'Invalid selection for workout type, equipment, or intensity.' END AS message
FROM score_requests"""

ORACLE["validate_users"] = with_views("new_users") + f"""
SELECT seq, email, errs = '' AS valid, errs AS errors
FROM (SELECT seq, email, {_user_errors()} AS errs FROM new_users)"""

ORACLE["validate_logs"] = with_views("new_logs") + f"""
SELECT seq, errs = '' AS valid, errs AS errors FROM (SELECT seq, {_log_errors()} AS errs FROM new_logs)"""

ORACLE["orphan_logs"] = with_views("users", "logs") + """
SELECT id, user_id, workout_date FROM logs l
WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.is_active AND u.id = l.user_id)"""

_OK = "(r.user_id IS NOT NULL AND u.id IS NOT NULL AND u.is_active)"
ORACLE["resolve_principals"] = with_views("users", "requests") + f"""
SELECT r.request_id, r.user_id, r.ts,
       coalesce({_auth('r', 'u')}, 'ok') AS outcome,
       CASE WHEN {_OK} THEN u.email END AS user_email,
       CASE WHEN {_OK} THEN u.is_active END AS user_is_active,
       CASE WHEN {_OK} THEN u.age END AS user_age,
       CASE WHEN {_OK} THEN u.goal END AS user_goal,
       CASE WHEN {_OK} THEN u.equipment END AS user_equipment,
       CASE WHEN {_OK} THEN u.created_at END AS user_created_at
FROM requests r LEFT JOIN users u ON u.id = r.user_id"""

ORACLE["resolve_logins"] = with_views("users", "logins") + """
SELECT l.attempt_id, l.email,
       CASE WHEN u.id IS NULL OR NOT coalesce(l.password_ok, false) THEN 'bad_credentials' ELSE 'ok' END AS outcome,
       CASE WHEN u.id IS NOT NULL AND coalesce(l.password_ok, false) THEN u.id END AS user_id
FROM logins l LEFT JOIN users u ON u.email = l.email"""

_REG = with_views("users", "new_users") + f""",
nb AS (SELECT seq,
              CASE WHEN position('@' IN email) > 0
                   THEN split_part(email, '@', 1) || '@' || lower(split_part(email, '@', -1))
                   ELSE email END AS email,
              age, goal, equipment FROM new_users),
nc AS (SELECT *, {_user_errors()} AS errs FROM nb),
firsts AS (SELECT email, min(seq) AS first_seq FROM nc
           WHERE errs = '' AND email NOT IN (SELECT email FROM users) GROUP BY email),
dec AS (SELECT nc.*, CASE WHEN errs <> '' THEN 'invalid' WHEN nc.seq = f.first_seq THEN 'created'
                          ELSE 'conflict' END AS outcome
        FROM nc LEFT JOIN firsts f ON f.email = nc.email),
ided AS (SELECT dec.*, CASE WHEN outcome = 'created'
             THEN (SELECT coalesce(max(id), 0) FROM users) + 1 + seq - (SELECT min(seq) FROM new_users) END AS id
         FROM dec)"""
ORACLE["register_users"] = _REG + "\nSELECT seq, email, id, outcome, errs AS errors FROM ided"
ORACLE["register_users_table"] = _REG + f"""
SELECT id, email, is_active, age, goal, equipment, created_at, updated_at FROM users
UNION ALL
SELECT id, email, true, age, goal, equipment, {NOW}, {NOW} FROM ided WHERE outcome = 'created'"""

ORACLE["training_frame"] = with_views("training") + "\nSELECT * FROM training"

ORACLE["training_csv"] = with_views("training") + """
SELECT workout_type, equipment, intensity, CAST(duration_min AS DOUBLE) AS duration_min, calories_burned, goal
FROM training"""

ORACLE["training_csv_by_name"] = ORACLE["training_csv"]

ORACLE["live_requests"] = with_views("requests", "issues") + """
SELECT r.request_id, r.user_id, r.ts,
       CASE WHEN r.user_id IS NULL THEN 'unauthorized'
            WHEN EXISTS (SELECT 1 FROM issues i
                         WHERE i.user_id = r.user_id AND i.issued_at <= r.ts
                           AND epoch_us(r.ts) // 1000000 <= epoch_us(i.issued_at) // 1000000 + 1800)
            THEN 'live' ELSE 'expired' END AS outcome
FROM requests r"""

_CREATE_LOGS = with_views("users", "logs", "new_logs") + f""",
nl AS (SELECT n.*, {_auth('n', 'u')} AS auth, {_log_errors()} AS errs
       FROM new_logs n LEFT JOIN users u ON u.id = n.user_id),
dec AS (SELECT *, CASE WHEN auth IS NOT NULL THEN auth WHEN errs <> '' THEN 'invalid' ELSE 'created' END AS outcome
        FROM nl),
ided AS (SELECT dec.*, CASE WHEN outcome = 'created'
             THEN (SELECT coalesce(max(id), 0) FROM logs) + 1 + seq - (SELECT min(seq) FROM new_logs) END AS new_id
         FROM dec)"""
ORACLE["create_logs"] = _CREATE_LOGS + "\nSELECT seq, user_id, new_id AS id, outcome, errs AS errors FROM ided"
ORACLE["create_logs_table"] = _CREATE_LOGS + f"""
SELECT * FROM logs
UNION ALL
SELECT new_id, user_id, CAST(strptime(workout_date, '%Y-%m-%d') AS DATE), duration_min, intensity, workout_type,
       calories_burned, {NOW}, {NOW}
FROM ided WHERE outcome = 'created'"""

_PATCH_CHG = (f"SELECT seq, 'patch' AS op, id, user_id, body, {_NO_CREATE} FROM patches")
_DELETE_CHG = (f"SELECT seq, 'delete' AS op, id, user_id, NULL::VARCHAR AS body, {_NO_CREATE} FROM deletes")
ORACLE["patch_logs"] = _apply_query(["logs", "patches"], _PATCH_CHG, False, "outcomes")
ORACLE["patch_logs_table"] = _apply_query(["logs", "patches"], _PATCH_CHG, False, "table")
ORACLE["delete_logs"] = _apply_query(["logs", "deletes"], _DELETE_CHG, False, "outcomes")
ORACLE["delete_logs_table"] = _apply_query(["logs", "deletes"], _DELETE_CHG, False, "table")
ORACLE["apply_changes"] = _apply_query(["users", "logs", "changes"], "SELECT * FROM changes", True, "outcomes")
ORACLE["apply_changes_table"] = _apply_query(["users", "logs", "changes"], "SELECT * FROM changes", True, "table")
ORACLE["outcome_counts"] = (_apply_query(["users", "logs", "changes"], "SELECT * FROM changes", True, "outcomes")
                            .rsplit("SELECT seq, op, id, user_id, outcome FROM outcomes", 1)[0]
                            + "SELECT op, outcome, CAST(count(*) AS BIGINT) AS n FROM outcomes GROUP BY op, outcome")

ORACLE["cascade_delete"] = with_views("users", "logs") + """
SELECT id, user_id FROM logs l WHERE NOT EXISTS (SELECT 1 FROM users u WHERE NOT u.is_active AND u.id = l.user_id)"""

_BUCKET = "(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8))::BIGINT % 100)"
ORACLE["md5_split"] = with_views("training") + f"""
SELECT id, {_BUCKET.format(k='id')} AS bucket,
       CASE WHEN {_BUCKET.format(k='id')} < 20 THEN 'test' ELSE 'train' END AS part
FROM training"""

_ORD = ("CASE intensity WHEN 'very_low' THEN 1 WHEN 'low' THEN 2 WHEN 'moderate' THEN 3 "
        "WHEN 'high' THEN 4 END")
ORACLE["standardize"] = with_views("training") + f""",
t AS (SELECT id, CASE WHEN {_BUCKET.format(k='id')} < 20 THEN 'test' ELSE 'train' END AS part,
             CAST(duration_min AS DOUBLE) AS d, calories_burned AS c, CAST({_ORD} AS DOUBLE) AS i FROM training),
s AS (SELECT avg(d) AS md, stddev_pop(d) AS sd, avg(c) AS mc, stddev_pop(c) AS sc, avg(i) AS mi,
             stddev_pop(i) AS si FROM t WHERE part = 'train')
SELECT id, part,
  round((d - md) / CASE WHEN sd IS NULL OR sd = 0 THEN 1 ELSE sd END, 6) AS duration_min_scaled,
  round((c - mc) / CASE WHEN sc IS NULL OR sc = 0 THEN 1 ELSE sc END, 6) AS calories_burned_scaled,
  round((i - mi) / CASE WHEN si IS NULL OR si = 0 THEN 1 ELSE si END, 6) AS intensity_numeric_scaled
FROM t, s"""

ORACLE["vocabulary"] = with_views("training") + """
SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS BIGINT) AS index
FROM (SELECT DISTINCT 'workout_type' AS feature, workout_type AS value FROM training WHERE workout_type IS NOT NULL
      UNION SELECT DISTINCT 'equipment', equipment FROM training WHERE equipment IS NOT NULL
      UNION SELECT DISTINCT 'goal', goal FROM training WHERE goal IS NOT NULL)"""


def _oh(col: str, vocab: str) -> str:
    return (f"CASE WHEN coalesce(list_position({vocab}, {col}), 0) > 0 "
            f"THEN CAST(list_position({vocab}, {col}) - 1 AS INTEGER) END AS {col}_slot, "
            f"CAST(len({vocab}) AS INTEGER) AS {col}_width, "
            f"array_to_string(list_transform({vocab}, lambda x: CASE WHEN x = {col} THEN '1' ELSE '0' END), ',') "
            f"AS {col}_onehot")


ORACLE["one_hot"] = with_views("training") + f""",
v AS (SELECT list_sort(list_distinct(list(workout_type))) AS vw, list_sort(list_distinct(list(equipment))) AS ve
      FROM training)
SELECT id, {_oh('workout_type', 'vw')}, {_oh('equipment', 've')} FROM training, v"""

ORACLE["best_split"] = with_views("training") + f""",
t AS (SELECT CAST(duration_min AS DOUBLE) AS duration_min, calories_burned,
             CAST({_ORD} AS DOUBLE) AS intensity_numeric, workout_type, equipment, goal
      FROM training WHERE goal IS NOT NULL),
classes AS (SELECT DISTINCT goal FROM t),
num AS (SELECT 'duration_min' AS feature, duration_min AS value, goal FROM t
        UNION ALL SELECT 'calories_burned', calories_burned, goal FROM t
        UNION ALL SELECT 'intensity_numeric', intensity_numeric, goal FROM t),
nv AS (SELECT feature, value, goal, count(*) AS n FROM num WHERE value IS NOT NULL GROUP BY feature, value, goal),
vals AS (SELECT DISTINCT feature, value FROM nv),
grid AS (SELECT v.feature, v.value, c.goal, coalesce(nv.n, 0) AS n
         FROM vals v CROSS JOIN classes c
         LEFT JOIN nv ON nv.feature = v.feature AND nv.value = v.value AND nv.goal = c.goal),
cum AS (SELECT feature, value, goal,
               sum(n) OVER (PARTITION BY feature, goal ORDER BY value) AS l,
               sum(n) OVER (PARTITION BY feature, goal) AS tot FROM grid),
thr AS (SELECT feature, value, lead(value) OVER (PARTITION BY feature ORDER BY value) AS nxt FROM vals),
ncand AS (SELECT c.feature, (c.value + t.nxt) / 2 AS threshold,
                 CAST(sum(l) AS DOUBLE) AS nl, CAST(sum(tot - l) AS DOUBLE) AS nr,
                 CAST(sum(l * l) AS DOUBLE) AS ql, CAST(sum((tot - l) * (tot - l)) AS DOUBLE) AS qr
          FROM cum c JOIN thr t ON t.feature = c.feature AND t.value = c.value
          WHERE t.nxt IS NOT NULL GROUP BY c.feature, threshold),
cat AS (SELECT 'workout_type' AS col, workout_type AS value, goal FROM t
        UNION ALL SELECT 'equipment', equipment, goal FROM t),
cv AS (SELECT col, value, goal, count(*) AS n FROM cat GROUP BY col, value, goal),
ct AS (SELECT col, goal, sum(n) AS tot FROM cv GROUP BY col, goal),
cvals AS (SELECT DISTINCT col, value FROM cv WHERE value IS NOT NULL),
cgrid AS (SELECT v.col, v.value, ct.goal, ct.tot, coalesce(cv.n, 0) AS r
          FROM cvals v JOIN ct ON ct.col = v.col
          LEFT JOIN cv ON cv.col = v.col AND cv.value = v.value AND cv.goal = ct.goal),
ccand AS (SELECT col || '=' || value AS feature, 0.5 AS threshold,
                 CAST(sum(tot - r) AS DOUBLE) AS nl, CAST(sum(r) AS DOUBLE) AS nr,
                 CAST(sum((tot - r) * (tot - r)) AS DOUBLE) AS ql, CAST(sum(r * r) AS DOUBLE) AS qr
          FROM cgrid GROUP BY col, value),
allc AS (SELECT feature, CAST(threshold AS DOUBLE) AS threshold, nl, nr,
                ((nl - ql / nl) + (nr - qr / nr)) / (nl + nr) AS impurity
         FROM (SELECT * FROM ncand UNION ALL SELECT * FROM ccand) WHERE nl > 0 AND nr > 0),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(impurity, 9), threshold) AS rn
                        FROM allc) WHERE rn = 1),
top AS (SELECT feature FROM pick ORDER BY round(impurity, 9), feature LIMIT 1)
SELECT feature, round(threshold, 6) AS threshold, round(impurity, 6) AS impurity,
       CAST(nl AS BIGINT) AS n_left, CAST(nr AS BIGINT) AS n_right,
       feature = (SELECT feature FROM top) AS best
FROM pick"""

ORACLE["user_weekly_stats"] = with_views("logs") + """,
w AS (SELECT user_id, CAST(date_trunc('week', workout_date) AS DATE) AS week, CAST(count(*) AS BIGINT) AS n_logs,
             CAST(sum(duration_min) AS BIGINT) AS total_minutes, avg(calories_burned) AS avg_calories
      FROM logs GROUP BY user_id, week)
SELECT user_id, week, n_logs, total_minutes, round(avg_calories, 6) AS avg_calories,
       CAST(sum(total_minutes) OVER (PARTITION BY user_id ORDER BY week
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_minutes
FROM w"""

_WEEKS = with_views("logs") + """,
w AS (SELECT user_id, CAST(date_trunc('week', workout_date) AS DATE) AS week, count(*) AS n_logs,
             CAST(coalesce(sum(duration_min), 0) AS BIGINT) AS total_minutes
      FROM logs WHERE user_id IS NOT NULL AND workout_date IS NOT NULL GROUP BY ALL),
p AS (SELECT *, lag(week) OVER u AS prev_week, lag(total_minutes) OVER u AS prev_minutes,
             CAST(sum(total_minutes) OVER u AS BIGINT) AS cum_minutes FROM w WINDOW u AS (PARTITION BY user_id ORDER BY week)),
g AS (SELECT *, sum(CASE WHEN week = prev_week + 7 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY week) AS streak FROM p)"""
ORACLE["user_progress"] = _WEEKS + """
SELECT user_id, week, n_logs, total_minutes, cum_minutes,
       row_number() OVER (PARTITION BY user_id, streak ORDER BY week) AS streak_week,
       CAST((week - prev_week) // 7 - 1 AS BIGINT) AS pause_weeks, total_minutes - prev_minutes AS minutes_change
FROM g"""
ORACLE["user_streaks"] = _WEEKS + """,
s AS (SELECT user_id, streak, count(*) AS weeks, min(week) AS first_week, max((week - prev_week) // 7 - 1) AS pause
      FROM g GROUP BY user_id, streak)
SELECT user_id, CAST(sum(weeks) AS BIGINT) AS n_weeks, count(*) AS n_streaks, max(weeks) AS longest_streak,
       first(first_week ORDER BY weeks DESC, first_week) AS longest_from, CAST(coalesce(max(pause), 0) AS BIGINT) AS longest_pause
FROM s GROUP BY user_id"""

ORACLE["stream_intake"] = with_views("users", "logs", "new_logs") + f""",
nl AS (SELECT n.*, {_auth('n', 'u')} AS auth, {_log_errors()} AS errs
       FROM new_logs n LEFT JOIN users u ON u.id = n.user_id)
SELECT seq, user_id,
       CASE WHEN auth IS NOT NULL THEN auth WHEN errs <> '' THEN 'invalid' ELSE 'accepted' END AS outcome,
       errs AS errors
FROM nl"""

# The streamed change list arrives in one micro-batch per file; the newest
# snapshot equals the batch result.
ORACLE["stream_changes"] = ORACLE["apply_changes_table"]

ORACLE["cascade_delete_users"] = with_views("users") + """
SELECT id, email FROM users WHERE coalesce(is_active, true)"""
ORACLE["read_users"] = with_views("users") + """
SELECT id, email, is_active, age, goal, equipment, created_at, updated_at FROM users"""
ORACLE["select_features"] = with_views("training") + """
SELECT workout_type, equipment, intensity, duration_min, calories_burned, goal FROM training"""

# One file is one micro-batch: ids are those of a batch of creates.
ORACLE["stream_intake_table"] = ORACLE["create_logs_table"]
ORACLE["cascade_tombstones"] = ORACLE["cascade_delete"]

# What is determined of scoring whatever the tree predicts.
ORACLE["score_outcomes"] = with_views("score_requests") + f"""
SELECT request_id, {_ACCEPTED} AS accepted,
       CASE WHEN NOT {_ACCEPTED} THEN 'Invalid selection for workout type, equipment, or intensity.' END AS message,
       {_ACCEPTED} AS has_prediction, {_ACCEPTED} AS has_result
FROM score_requests"""
ORACLE["reloaded_scores"] = ORACLE["score_outcomes"]
ORACLE["stream_score_outcomes"] = ORACLE["score_outcomes"]

# Exact trees of the depth of the queries, written out level by level.
_DEPTH = 3
_NUM, _CAT = ["duration_min", "calories_burned", "intensity_numeric"], ["workout_type", "equipment"]
_PART = "CASE WHEN {b} < 20 THEN 'test' ELSE 'train' END"


def _features(key: str, y: str, name: str = "f", extra: str = "id, user_id, goal") -> str:
    return f"""{name} AS (SELECT {extra}, CAST(duration_min AS DOUBLE) AS duration_min, calories_burned,
      CAST({_ORD} AS DOUBLE) AS intensity_numeric, workout_type, equipment, {y} AS y,
      {_PART.format(b=_BUCKET.format(k=key))} AS part FROM training),
{name}train AS (SELECT * FROM {name} WHERE part = 'train')"""


_NODE_COLUMNS = ("node, feature, round(threshold, 6) AS threshold, n, round(impurity, 6) AS impurity, label, round(mean, 6) AS mean")
_GOAL_TREE = with_views("training") + ",\n" + _features("user_id", "goal") + ",\n" + tree_ctes("ftrain", "k", _DEPTH, _NUM, _CAT)
ORACLE["exact_tree"] = _GOAL_TREE + f"\nSELECT {_NODE_COLUMNS} FROM knodes"
ORACLE["exact_tree_scores"] = (_GOAL_TREE + ",\n" + scored_ctes("f", "k", _DEPTH, _NUM, _CAT, "id, user_id, part, goal")
                               + "\nSELECT id, user_id, part, goal, label AS predicted_goal FROM kscored")
ORACLE["exact_tree_accuracy"] = with_views("training") + ",\n" + ",\n".join(
    ",\n".join([_features(key, "goal", p + "f"), tree_ctes(p + "ftrain", p, _DEPTH, _NUM, _CAT),
                scored_ctes(p + "f", p, _DEPTH, _NUM, _CAT, "part, goal")]) for key, p in (("id", "i"), ("user_id", "u"))) + "\n" \
    + " UNION ALL ".join(f"""SELECT '{key}' AS split_key, count(*) AS n_test, count(*) FILTER (WHERE coalesce(label = goal, false)) AS n_correct,
       round(avg(CASE WHEN label = goal THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM {p}scored WHERE part = 'test' AND goal IS NOT NULL""" for key, p in (("id", "i"), ("user_id", "u")))
ORACLE["exact_score_requests"] = with_views("training", "score_requests") + ",\n" + _features("user_id", "goal") + ",\n" \
    + tree_ctes("ftrain", "k", _DEPTH, _NUM, _CAT) + f""",
q AS (SELECT request_id, {_ACCEPTED} AS accepted, CAST(duration_min AS DOUBLE) AS duration_min, calories_burned,
             CAST({_ORD} AS DOUBLE) AS intensity_numeric, workout_type, equipment FROM score_requests),
""" + scored_ctes("q", "k", _DEPTH, _NUM, _CAT, "request_id, accepted") + """
SELECT request_id, accepted,
       CASE WHEN NOT accepted THEN 'Invalid selection for workout type, equipment, or intensity.' END AS message,
       CASE WHEN accepted THEN label END AS predicted_goal,
       CASE WHEN accepted THEN 'Input: ' || workout_type || ', ' || equipment || ' -> Predicted Goal: ' || label END AS result
FROM kscored"""
ORACLE["stream_exact_scores"] = ORACLE["exact_score_requests"]
_RNUM = ["calories_burned", "intensity_numeric"]
_MINUTES_TREE = with_views("training") + ",\n" + _features("user_id", "CAST(duration_min AS DOUBLE)") + ",\n" \
    + tree_ctes("ftrain", "k", _DEPTH, _RNUM, _CAT, regress=True)
ORACLE["duration_tree"] = _MINUTES_TREE + f"\nSELECT {_NODE_COLUMNS} FROM knodes"
ORACLE["duration_errors"] = _MINUTES_TREE + ",\n" + scored_ctes("f", "k", _DEPTH, _RNUM, _CAT, "part, duration_min") + """
SELECT part, count(*) AS n, round(avg((mean - duration_min) * (mean - duration_min)), 6) AS mse,
       round(avg(abs(mean - duration_min)), 6) AS mae
FROM kscored WHERE duration_min IS NOT NULL GROUP BY part"""
ORACLE["profile_tree_scores"] = with_views("training") + ",\n" + _features("user_id", "workout_type") + ",\n" \
    + tree_ctes("ftrain", "k", _DEPTH, [], ["goal", "equipment"]) + ",\n" \
    + scored_ctes("f", "k", _DEPTH, [], ["goal", "equipment"], "id, part, workout_type") + """
SELECT id, part, workout_type, label AS predicted_type FROM kscored"""

# R-2: runs.  The change list is stated with typed values: what is sent (s_*), its
# value (v_*), and whether the body breaks a rule.
_RUNS = with_views("users", "logs") + """,
runs AS (SELECT id, user_id, workout_date AS run_date, calories_burned / 64 AS distance_km, duration_min,
                CASE WHEN id % 7 <> 0 THEN CAST(90 + id % 80 AS INTEGER) END AS heart_rate, created_at, updated_at
         FROM logs WHERE workout_type = 'running')"""
ORACLE["validate_runs"] = _RUNS + """,
n AS (SELECT id AS seq, id % 13 = 5 OR run_date IS NULL AS d, NOT coalesce(CASE WHEN id % 19 = 4 THEN 0 ELSE distance_km END > 0, false) AS k,
             NOT coalesce(duration_min > 0, false) AS m, CASE WHEN id % 23 = 6 THEN true ELSE coalesce(heart_rate <= 0, false) END AS h FROM runs),
e AS (SELECT seq, concat_ws(',', CASE WHEN d THEN 'date_parse' END, CASE WHEN k THEN 'distance_positive' END,
                            CASE WHEN m THEN 'duration_positive' END, CASE WHEN h THEN 'heart_rate_positive' END) AS errors FROM n)
SELECT seq, errors = '' AS valid, errors FROM e"""
_RUN_CHANGES = _RUNS + f""",
q AS (
  SELECT id * 8 AS seq, 'patch' AS op, id, user_id, NOT coalesce(duration_min + 5 > 0, false) AS bad, true AS s_km, CAST(7.5 AS DOUBLE) AS v_km,
         true AS s_min, duration_min + 5 AS v_min, false AS s_hr, CAST(NULL AS INTEGER) AS v_hr, CAST(NULL AS DATE) AS run_date FROM runs
  UNION ALL SELECT id * 8 + 1, 'delete', id, CASE WHEN id % 45 = 0 THEN user_id + 1 ELSE user_id END, false,
         false, NULL, false, NULL, false, NULL, NULL FROM runs WHERE id % 15 = 0
  UNION ALL SELECT id * 8 + 2, 'patch', id, user_id, id % 25 <> 0 AND id % 10 IN (2, 3), id % 25 = 0, NULL, false, NULL,
         id % 25 <> 0, CASE WHEN id % 10 <> 1 THEN 120 END, NULL FROM runs
  UNION ALL SELECT id * 8 + 3, 'create', -id, user_id, NOT coalesce(distance_km > 0 AND duration_min + 1 > 0 AND run_date IS NOT NULL, false),
         true, distance_km, true, duration_min + 1, true, heart_rate, run_date FROM runs WHERE id % 20 = 0
  UNION ALL SELECT id * 8 + 3, 'create', -id, user_id, true, true, 1, true, 1, false, NULL, NULL FROM runs WHERE id % 20 = 5
  UNION ALL SELECT id * 8 + 4, 'create', id, user_id, NOT coalesce(distance_km > 0 AND duration_min + 1 > 0 AND run_date IS NOT NULL, false),
         true, distance_km, true, duration_min + 1, true, heart_rate, run_date FROM runs WHERE id % 60 = 0
  UNION ALL SELECT id * 8 + 5, 'patch', -id, user_id, NOT coalesce(duration_min + 9 > 0, false), false, NULL, true, duration_min + 9,
         false, NULL, NULL FROM runs WHERE id % 20 = 0
  UNION ALL SELECT id * 8 + 6, 'delete', -id, user_id, false, false, NULL, false, NULL, false, NULL, NULL FROM runs WHERE id % 40 = 0),
c AS (SELECT q.*, {_auth('q', 'u')} AS auth FROM q LEFT JOIN users u ON u.id = q.user_id),
born AS (SELECT * FROM c WHERE op = 'create' AND auth IS NULL AND NOT bad AND id NOT IN (SELECT id FROM runs)
         QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
e AS (SELECT *, CAST(NULL AS BIGINT) AS since FROM runs
      UNION ALL SELECT id, user_id, run_date, v_km, v_min, v_hr, {NOW}, {NOW}, seq FROM born),
h AS (SELECT c.*, coalesce(c.auth IS NULL AND NOT c.bad AND e.user_id = c.user_id AND (e.since IS NULL OR c.seq > e.since), false) AS hit,
             e.distance_km AS b_km, e.duration_min AS b_min, e.heart_rate AS b_hr
      FROM c LEFT JOIN e ON e.id = c.id WHERE c.op <> 'create'),
x AS (SELECT *, min(CASE WHEN op = 'delete' AND hit THEN seq END) OVER (PARTITION BY id) AS dead FROM h),
o AS (SELECT *, CASE WHEN auth IS NOT NULL THEN auth WHEN bad THEN 'invalid' WHEN NOT hit OR seq > dead THEN 'not_found'
                     WHEN op = 'delete' THEN 'deleted' WHEN s_km AND v_km IS NULL THEN 'rejected_not_null' ELSE 'ok' END AS outcome FROM x),
f AS (SELECT id, max(seq) FILTER (WHERE s_km) AS km, max(seq) FILTER (WHERE s_min) AS mi, max(seq) FILTER (WHERE s_hr) AS hr,
             bool_or((s_km AND v_km IS DISTINCT FROM b_km) OR (s_min AND v_min IS DISTINCT FROM b_min)
                     OR (s_hr AND v_hr IS DISTINCT FROM b_hr)) AS changed
      FROM o WHERE op = 'patch' AND outcome = 'ok' GROUP BY id)"""
ORACLE["run_changes"] = _RUN_CHANGES + """
SELECT seq, op, id, user_id, outcome FROM o
UNION ALL
SELECT c.seq, c.op, c.id, c.user_id, CASE WHEN c.auth IS NOT NULL THEN c.auth WHEN c.bad THEN 'invalid'
       WHEN b.seq IS NOT NULL THEN 'created' ELSE 'conflict' END
FROM c LEFT JOIN born b ON b.seq = c.seq WHERE c.op = 'create'"""
ORACLE["run_changes_table"] = _RUN_CHANGES + f"""
SELECT e.id, e.user_id, e.run_date, CASE WHEN km.seq IS NOT NULL THEN km.v_km ELSE e.distance_km END AS distance_km,
       CASE WHEN mi.seq IS NOT NULL THEN mi.v_min ELSE e.duration_min END AS duration_min,
       CASE WHEN hr.seq IS NOT NULL THEN hr.v_hr ELSE e.heart_rate END AS heart_rate, e.created_at,
       CASE WHEN coalesce(f.changed, false) THEN {NOW} ELSE e.updated_at END AS updated_at
FROM e LEFT JOIN f ON f.id = e.id LEFT JOIN o km ON km.seq = f.km LEFT JOIN o mi ON mi.seq = f.mi LEFT JOIN o hr ON hr.seq = f.hr
WHERE e.id NOT IN (SELECT id FROM x WHERE dead IS NOT NULL)"""
