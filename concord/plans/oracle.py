"""DuckDB SQL for the registered queries, written apart from the column expressions."""

from __future__ import annotations

from ..functions.text import LOCATION_STOPWORDS, PLACEHOLDER_CLIENTS, TITLE_STOPWORDS, VIRTUAL_MARKERS
from ..schemas import CALENDAR_FIELDS, CRM_FIELDS, FLAG_CODES
from .derive import CALENDAR_SQL, CRM_SQL

_tables = {"orders": "orders", "customer": "customer", "nation": "nation"}
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
_key = lambda x: f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"
_tokens = lambda x: f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda t: t <> '')"
_content = lambda x: f"list_distinct(list_filter({_tokens(x)}, lambda t: length(t) > 2 AND NOT list_contains([{_quoted(TITLE_STOPWORDS)}], t)))"
_long = lambda x: f"list_filter({_tokens(x)}, lambda t: length(t) >= 4)"
_email = "CASE WHEN contains(replace(replace({0}, '[at]', '@'), '[dot]', '.'), '@') THEN lower(replace(replace({0}, '[at]', '@'), '[dot]', '.')) END"


def _acronyms(words: str) -> str:
    short = f"list_transform({words}, lambda t: CASE WHEN length(t) <= 2 THEN t ELSE t[1] END)"
    runs = [f"list_transform(range(1, greatest(len({words}) - {n} + 2, 1)), lambda i: array_to_string(({short})[i:i + {n - 1}], ''))" for n in (2, 3, 4)]
    return f"list_distinct(list_concat(list_concat({runs[0]}, {runs[1]}), {runs[2]}))"


_BASE = f"""
crm_raw AS ({CRM_SQL.format(**_tables)}),
cal_raw AS ({CALENDAR_SQL.format(**_tables)}),
crm_dated AS (
  SELECT *, CASE WHEN meeting_date = 'not a date' THEN NULL WHEN meeting_date LIKE '____-__-__' THEN CAST(meeting_date AS DATE) ELSE CAST(strptime(meeting_date, '%m-%d/%Y') AS DATE) END AS event_date,
    nullif(trim(client_name), '') AS client, CASE WHEN status = 'pending' THEN 'unknown' ELSE lower(status) END AS st FROM crm_raw
),
crm_n AS (
  SELECT *, CASE WHEN meeting_time IS NOT NULL THEN event_date + CAST(meeting_time || ':00' AS TIME) END AS start FROM crm_dated
),
crm_flags AS (
  SELECT crm_id AS source_id, list_filter([
    CASE WHEN event_date IS NULL THEN 'UNPARSABLE_DATE:meeting_date' WHEN meeting_date NOT LIKE '____-__-__' THEN 'MALFORMED_DATE:meeting_date' END,
    CASE WHEN meeting_time IS NULL THEN 'TIME_MISSING:meeting_time' END, CASE WHEN start IS NOT NULL THEN 'TIMEZONE_ASSUMED:meeting_time' END,
    CASE WHEN st = 'unknown' THEN 'UNKNOWN_STATUS:status' END,
    CASE WHEN client IS NULL AND meeting_type = 'Internal' THEN 'INTERNAL_NO_CLIENT:client_name' WHEN lower(client) IN ({_quoted(PLACEHOLDER_CLIENTS)}) THEN 'PLACEHOLDER_CLIENT:client_name' END
  ], lambda f: f IS NOT NULL) AS flags FROM crm_n
),
cal_timed AS (
  SELECT *, CAST(strptime(left(start_time, 16), '%Y-%m-%dT%H:%M') AS TIMESTAMP) AS wall, CAST(end_time AS TIMESTAMP) AS end_at, string_split(attendees, '|') AS listed,
    CASE WHEN length(start_time) = 16 THEN 'MALFORMED_DATETIME:start_time' END AS cut FROM cal_raw
),
cal_n AS (
  SELECT *, CASE WHEN start_time LIKE '%Z' THEN (wall AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'
      WHEN start_time LIKE '%-05:00' THEN ((wall + INTERVAL 5 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' ELSE wall END AS start,
    list_transform(listed, lambda a: struct_pack(raw := a, email := {_email.format("a")}, key := coalesce({_email.format("a")}, lower(trim(a))), fixed := a LIKE '%[at]%' OR a LIKE '%[dot]%')) AS people FROM cal_timed
),
cal_people AS (
  SELECT *, CAST(start AS DATE) AS event_date, list_filter(people, lambda p, i: list_position(list_transform(people, lambda q: q.key), p.key) = i) AS once FROM cal_n
),
cal_flags AS (
  SELECT event_id AS source_id, list_filter(list_concat([cut, 'TIMEZONE_ASSUMED:start_time'],
    list_transform(people, lambda p: CASE WHEN p.email IS NULL THEN 'NON_EMAIL_ATTENDEE:attendees' WHEN p.fixed THEN 'MALFORMED_EMAIL:attendees' END)), lambda f: f IS NOT NULL) AS flags FROM cal_people
),
flags AS (
  SELECT 'crm' AS source, source_id, unnest(flags) AS f FROM crm_flags UNION ALL SELECT 'calendar', source_id, unnest(flags) FROM cal_flags
)
"""

_PAIRS = f"""
c AS (
  SELECT crm_id AS c_id, event_date AS c_date, start AS c_start, {_key("relationship_owner")} AS owner, {_key("client")} AS client,
    client IS NOT NULL AND lower(client) NOT IN ({_quoted(PLACEHOLDER_CLIENTS)}) AS usable, client_company AS company, {_tokens("client_company")} AS company_words,
    {_content("concat_ws(' ', subject, notes, client_company)")} AS content, {_tokens("subject")} AS words, meeting_type, lower(location) AS place, {_long("location")} AS place_words
  FROM crm_n
), k AS (
  SELECT event_id AS k_id, event_date AS k_date, start AS k_start, {_key("split_part(organizer, '@', 1)")} AS organizer,
    list_filter(list_transform(once, lambda p: {_key("split_part(p.email, '@', 1)")}), lambda x: x <> '') AS attendees,
    list_distinct(list_filter(list_transform(once, lambda p: split_part(p.email, '@', 2)), lambda x: x IS NOT NULL)) AS domains,
    {_content("concat_ws(' ', title, description)")} AS content, {_tokens("title")} AS words, lower(location) AS place, {_long("location")} AS place_words,
    regexp_matches(lower(location), '{"|".join(VIRTUAL_MARKERS)}') AS virtual
  FROM cal_people
), cw AS MATERIALIZED (SELECT *, {_acronyms("words")} AS acronyms FROM c), kw AS MATERIALIZED (SELECT *, {_acronyms("words")} AS acronyms FROM k),
p AS (
  SELECT c_id, k_id,
    CASE WHEN owner = '' THEN NULL WHEN owner = organizer THEN 1.0 WHEN list_contains(attendees, owner) THEN 0.7 ELSE 0.0 END::DOUBLE AS p_owner,
    CASE WHEN usable THEN CASE WHEN list_contains(attendees, client) THEN 1.0 ELSE 0.0 END END::DOUBLE AS p_client,
    CASE WHEN company IS NOT NULL THEN CASE WHEN len(list_filter(domains, lambda d:
      (length(company_words[1]) >= 4 AND (starts_with(split_part(d, '.', 1), company_words[1]) OR starts_with(company_words[1], split_part(d, '.', 1))))
      OR split_part(d, '.', 1) = array_to_string(list_transform(company_words, lambda w: w[1]), ''))) > 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS p_company,
    CASE WHEN c_start IS NULL OR k_start IS NULL THEN 0.5 ELSE greatest(0.0, 1.0 - abs(epoch(c_start) - epoch(k_start)) / 3600.0 / 4.0) END::DOUBLE AS time,
    CASE WHEN len(cw.content) = 0 OR len(kw.content) = 0 THEN 0.0 WHEN len(list_intersect(cw.content, kw.content)) > 0
      THEN len(list_intersect(cw.content, kw.content))::DOUBLE / least(len(cw.content), len(kw.content))
      WHEN len(list_intersect(cw.acronyms, kw.words)) > 0 OR len(list_intersect(kw.acronyms, cw.words)) > 0 THEN 0.6 ELSE 0.0 END::DOUBLE AS title,
    0.6::DOUBLE * CASE WHEN cw.place IS NULL OR kw.place IS NULL THEN 0.5 WHEN contains(cw.place, kw.place) OR contains(kw.place, cw.place) THEN 1.0
      WHEN len(list_intersect(cw.place_words, kw.place_words)) > 0 THEN 0.6 ELSE 0.0 END
    + 0.4::DOUBLE * CASE WHEN kw.place IS NULL THEN 0.5 WHEN (lower(meeting_type) = 'virtual') = virtual THEN 1.0 ELSE 0.0 END AS structure
  FROM cw JOIN (SELECT *, unnest([k_date - 1, k_date, k_date + 1]) AS block FROM kw) kw ON c_date = block
), s AS (
  SELECT *, (coalesce(0.4::DOUBLE * p_owner, 0) + coalesce(0.4::DOUBLE * p_client, 0) + coalesce(0.2::DOUBLE * p_company, 0))
    / nullif((CASE WHEN p_owner IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN p_client IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN p_company IS NULL THEN 0 ELSE 0.2::DOUBLE END), 0) AS pp FROM p
), t AS (
  SELECT c_id, k_id, coalesce(pp, 0) AS participants, time, title, structure,
    0.4::DOUBLE * coalesce(pp, 0) + 0.3::DOUBLE * time + 0.2::DOUBLE * title + 0.1::DOUBLE * structure AS score FROM s
), found AS (SELECT * FROM t WHERE score >= 0.45)
"""


def _greedy(rounds: int = 8) -> str:
    """Rounds of mutual bests, unrolled."""
    out = ["r0 AS MATERIALIZED (SELECT c_id, k_id, score FROM found)"]
    for i in range(rounds):
        ranks = "row_number() OVER (PARTITION BY c_id ORDER BY score DESC, k_id) AS a, row_number() OVER (PARTITION BY k_id ORDER BY score DESC, c_id) AS b"
        out.append(f"m{i} AS MATERIALIZED (SELECT c_id, k_id, score FROM (SELECT *, {ranks} FROM r{i}) WHERE a = 1 AND b = 1)")
        out.append(f"r{i + 1} AS MATERIALIZED (SELECT r.* FROM r{i} r ANTI JOIN m{i} x ON r.c_id = x.c_id ANTI JOIN m{i} y ON r.k_id = y.k_id)")
    return ",\n".join(out) + ",\npairs AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(rounds)) + ")"


# Duplicates come in twos in the derived calendar: a record joins the earliest one that it matches.
_COLLAPSED = """
keyed AS (
  SELECT *, list_transform(list_filter(once, lambda p: NOT (p.email IS NOT NULL AND p.email = lower(organizer)) AND coalesce(split_part(p.email, '@', 2), '') <> 'firma.com'),
    lambda p: coalesce(p.email, lower(trim(p.raw)))) AS parties FROM cal_people
), joined AS (
  SELECT b.event_id AS dup, min(a.event_id) AS survivor FROM keyed a JOIN keyed b
    ON a.event_date = b.event_date AND lower(a.organizer) = lower(b.organizer) AND a.event_id < b.event_id AND NOT a.is_recurring AND NOT b.is_recurring
    AND list_has_any(a.parties, b.parties) AND (a.start IS NULL OR b.start IS NULL OR abs(epoch(a.start) - epoch(b.start)) <= 3600) GROUP BY b.event_id
), lead_of AS (
  SELECT a.event_id, CASE WHEN b.created_at < a.created_at THEN b.event_id ELSE a.event_id END AS leader, dup
  FROM cal_people a LEFT JOIN joined ON survivor = a.event_id LEFT JOIN cal_people b ON b.event_id = dup WHERE a.event_id NOT IN (SELECT dup FROM joined)
), cal_c AS (
  SELECT l.* EXCLUDE (event_id), f.event_id, f.dup, f.event_id || coalesce(',' || f.dup, '') AS ids FROM lead_of f JOIN cal_people l ON l.event_id = f.leader
), flag_raw AS (
  SELECT event_id, unnest(list_concat([struct_pack(code := cut, field := NULL, raw := start_time), struct_pack(code := 'TIMEZONE_ASSUMED:start_time', field := NULL, raw := start_time)],
    list_transform(people, lambda p: struct_pack(code := CASE WHEN p.email IS NULL THEN 'NON_EMAIL_ATTENDEE:attendees' WHEN p.fixed THEN 'MALFORMED_EMAIL:attendees' END, field := NULL, raw := p.raw)))) AS f, FROM cal_people
), cal_flag AS (
  SELECT coalesce(survivor, event_id) AS event_id, f.code AS code, f.raw AS raw, survivor IS NULL OR EXISTS (SELECT 1) AS own, count(*) FILTER (WHERE survivor IS NULL) AS n_own
  FROM flag_raw LEFT JOIN joined ON dup = event_id WHERE f.code IS NOT NULL GROUP BY ALL
), cal_all AS (
  SELECT event_id, code, raw, greatest(max(n_own), 1) AS n FROM cal_flag GROUP BY ALL
  UNION ALL SELECT survivor, 'DUPLICATE_COLLAPSED:event_id', dup, 1 FROM joined
), crm_joined AS (
  SELECT b.crm_id AS dup, min(a.crm_id) AS survivor FROM crm_n a JOIN crm_n b ON a.event_date = b.event_date AND lower(a.relationship_owner) = lower(b.relationship_owner)
    AND lower(a.client) = lower(b.client) AND a.crm_id < b.crm_id AND (a.start IS NULL OR b.start IS NULL OR abs(epoch(a.start) - epoch(b.start)) <= 3600) GROUP BY b.crm_id
), crm_c AS (
  SELECT c.*, c.crm_id || coalesce(',' || j.dup, '') AS ids, j.dup FROM crm_n c LEFT JOIN crm_joined j ON j.survivor = c.crm_id WHERE c.crm_id NOT IN (SELECT dup FROM crm_joined)
), crm_flag_raw AS (
  SELECT crm_id, split_part(f, ':', 1) AS code, CASE split_part(f, ':', 2) WHEN 'meeting_date' THEN meeting_date WHEN 'meeting_time' THEN meeting_time WHEN 'status' THEN status ELSE client_name END AS raw
  FROM crm_n JOIN (SELECT source_id, unnest(flags) AS f FROM crm_flags) ON source_id = crm_id
), crm_all AS (
  SELECT DISTINCT coalesce(survivor, crm_id) AS crm_id, code, raw FROM crm_flag_raw LEFT JOIN crm_joined ON dup = crm_id
  UNION ALL SELECT survivor, 'DUPLICATE_COLLAPSED', dup FROM crm_joined
)
"""
_place = lambda x: f"list_filter({_tokens(x)}, lambda t: length(t) >= 4 AND NOT list_contains([{_quoted(LOCATION_STOPWORDS)}], t))"
_rank = lambda x: f"coalesce(list_position(['tentative', 'scheduled', 'confirmed', 'completed'], {x}), 0)"
_MEETINGS = f"""
joint AS (
  SELECT lower(replace(c.ids || ',' || k.ids, ',', '-')) AS id, crm_id, k.event_id, k.organizer, k.start AS ks, c.start AS cs, c.location AS cl, k.location AS kl, c.st AS cst, k.status AS kst,
    c.relationship_owner AS owner, coalesce(k.event_date, c.event_date) AS event_date, coalesce(k.start, c.start) AS start, nullif(c.notes, '') AS cn, k.description AS kn, c.client, c.client_company
  FROM pairs p JOIN crm_c c ON c.crm_id = p.c_id JOIN cal_c k ON k.event_id = p.k_id
), both_sides AS (
  SELECT id, 'both' AS origin, event_date, start, crm_id, event_id, owner, 'crm' AS owner_source, 1 AS owner_others,
    coalesce(ks, cs) AS st_value, CASE WHEN ks IS NULL AND cs IS NULL THEN NULL WHEN ks IS NULL THEN 'crm' ELSE 'calendar' END AS st_source,
    CASE WHEN ks IS NULL AND cs IS NULL THEN NULL WHEN ks IS NULL OR cs IS NULL THEN 'absence' WHEN ks <> cs THEN 'contradiction' END AS st_kind,
    CASE WHEN cl IS NULL AND kl IS NULL THEN NULL WHEN cl IS NULL OR kl IS NULL THEN 'absence' WHEN lower(cl) = lower(kl) THEN NULL
      WHEN contains(lower(cl), lower(kl)) OR contains(lower(kl), lower(cl)) OR list_has_any({_place("cl")}, {_place("kl")}) THEN 'granularity' ELSE 'contradiction' END AS loc_kind,
    CASE WHEN cl IS NULL AND kl IS NULL THEN NULL WHEN kl IS NULL THEN 'crm' WHEN cl IS NULL OR lower(cl) = lower(kl) THEN 'calendar' WHEN contains(lower(cl), lower(kl)) THEN 'crm' WHEN contains(lower(kl), lower(cl)) THEN 'calendar'
      WHEN list_has_any({_place("cl")}, {_place("kl")}) AND length(cl) > length(kl) THEN 'crm' ELSE 'calendar' END AS loc_source, cl, kl,
    CASE WHEN cst = kst THEN NULL WHEN cst = 'cancelled' OR kst = 'cancelled' OR (cst IN ('tentative', 'confirmed') AND kst IN ('tentative', 'confirmed')) THEN 'contradiction' ELSE 'granularity' END AS status_kind,
    CASE WHEN cst = kst OR cst = 'cancelled' THEN 'crm' WHEN kst = 'cancelled' OR (cst IN ('tentative', 'confirmed') AND kst IN ('tentative', 'confirmed')) THEN 'calendar' WHEN {_rank("cst")} >= {_rank("kst")} THEN 'crm' ELSE 'calendar' END AS status_source,
    organizer, cst, kst, CASE WHEN cn IS NULL AND kn IS NOT NULL THEN 'absence' END AS notes_kind FROM joint
), meetings AS (
  SELECT id, origin, event_date, start, crm_id, event_id, owner, owner_source, owner_others, st_value, st_source, st_kind, CASE WHEN st_kind IS NULL THEN 0 ELSE 1 END AS st_others,
    CASE WHEN loc_source = 'crm' THEN cl ELSE kl END AS loc_value, loc_source, loc_kind, CASE WHEN loc_kind IS NULL THEN 0 ELSE 1 END AS loc_others,
    CASE WHEN status_source = 'crm' THEN cst ELSE kst END AS status_value, status_source, status_kind, CASE WHEN status_kind IS NULL THEN 0 ELSE 1 END AS status_others, notes_kind, organizer FROM both_sides
  UNION ALL SELECT lower(replace(ids, ',', '-')), 'crm_only', event_date, start, crm_id, NULL, relationship_owner, 'crm', 0, start, CASE WHEN start IS NOT NULL THEN 'crm' END, NULL, 0,
    location, CASE WHEN location IS NOT NULL THEN 'crm' END, NULL, 0, st, 'crm', NULL, 0, NULL, NULL FROM crm_c WHERE crm_id NOT IN (SELECT c_id FROM pairs)
  UNION ALL SELECT lower(replace(ids, ',', '-')), 'calendar_only', event_date, start, NULL, event_id, organizer, 'calendar', 0, start, CASE WHEN start IS NOT NULL THEN 'calendar' END, NULL, 0,
    location, CASE WHEN location IS NOT NULL THEN 'calendar' END, NULL, 0, status, 'calendar', NULL, 0, NULL, organizer FROM cal_c WHERE event_id NOT IN (SELECT k_id FROM pairs)
), kinds AS (
  SELECT id, unnest(['start_time', 'location', 'status', 'notes']) AS field, unnest([st_kind, loc_kind, status_kind, notes_kind]) AS kind FROM meetings
), meeting_flags AS (
  SELECT id, code, 1 AS n FROM meetings JOIN crm_all USING (crm_id)
  UNION ALL SELECT id, split_part(code, ':', 1), n FROM meetings JOIN cal_all USING (event_id)
)
"""
_WHOLE = f"{_BASE}, {_COLLAPSED}, {_PAIRS.replace('FROM cal_people', 'FROM cal_c').replace('FROM crm_n', 'FROM crm_c')}, {_greedy()}, {_MEETINGS}"

_TO_PAIRS = f"{_BASE}, {_COLLAPSED}, {_PAIRS.replace('FROM cal_people', 'FROM cal_c').replace('FROM crm_n', 'FROM crm_c')}, {_greedy()}"
_display = "array_to_string(list_transform(once, lambda p: coalesce(p.email, p.raw)), ',')"
# Both sides of every meeting: those of a pair, or one of them.
_SIDES = f"""
sides AS (
  SELECT lower(replace(c.ids || ',' || k.ids, ',', '-')) AS id, c.crm_id, k.event_id, subject, title, client, client_company, meeting_type, nullif(c.notes, '') AS cn, k.description AS kn, k.end_at, c.relationship_owner AS owner, {_display} AS listed
  FROM pairs p JOIN crm_c c ON c.crm_id = p.c_id JOIN cal_c k ON k.event_id = p.k_id
  UNION ALL SELECT lower(replace(ids, ',', '-')), crm_id, NULL, subject, NULL, client, client_company, meeting_type, nullif(notes, ''), NULL, NULL, relationship_owner, NULL FROM crm_c WHERE crm_id NOT IN (SELECT c_id FROM pairs)
  UNION ALL SELECT lower(replace(ids, ',', '-')), NULL, event_id, NULL, title, NULL, NULL, NULL, NULL, description, end_at, NULL, {_display} FROM cal_c WHERE event_id NOT IN (SELECT k_id FROM pairs)
)
"""


def _preferred(name: str, first: str, first_source: str, second: str, second_source: str) -> str:
    """Value, source, kind and number of alternatives of a field that prefers one source. An absence counts in pairs alone."""
    both = "crm_id IS NOT NULL AND event_id IS NOT NULL"
    return f"""coalesce({first}, {second}) AS {name}, CASE WHEN {first} IS NOT NULL THEN '{first_source}' WHEN {second} IS NOT NULL THEN '{second_source}' END AS {name}_source,
  CASE WHEN {both} AND {first} IS NULL AND {second} IS NOT NULL THEN 'absence' END AS {name}_kind,
  CASE WHEN {both} AND {second} IS NOT NULL AND {first} IS DISTINCT FROM {second} THEN 1 ELSE 0 END AS {name}_others"""


_people_crm = "(owner || coalesce(',' || client, ''))"
_end = "strftime(end_at, '%Y-%m-%d %H:%M:%S')"
_none = "CAST(NULL AS STRING)"
_DETAILS = f"""
told AS (
  SELECT lower(replace(c.ids || ',' || k.ids, ',', '-')) AS id,
    concat_ws(', ', CASE p_owner WHEN 1.0 THEN 'owner organised it' WHEN 0.7 THEN 'owner attended' WHEN 0.0 THEN 'owner absent' END, CASE p_client WHEN 1.0 THEN 'client found' WHEN 0.0 THEN 'client absent' END,
      CASE p_company WHEN 1.0 THEN 'company = domain' WHEN 0.0 THEN 'company ≠ domain' END) AS participants,
    CASE WHEN c_start IS NULL OR k_start IS NULL THEN 'one side has no time of day' WHEN abs(epoch(c_start) - epoch(k_start)) >= 14400 THEN printf('%.1f', abs(epoch(c_start) - epoch(k_start)) / 3600) || 'h apart'
      WHEN c_start = k_start THEN 'same start time' ELSE printf('%.0f', abs(epoch(c_start) - epoch(k_start)) / 60) || ' min apart' END AS time,
    CASE WHEN len(cw.content) = 0 OR len(kw.content) = 0 THEN 'no comparable text' WHEN len(list_intersect(cw.content, kw.content)) > 0 THEN 'shared: ' || array_to_string(list_sort(list_intersect(cw.content, kw.content)), ', ')
      WHEN len(list_intersect(cw.acronyms, kw.words)) > 0 OR len(list_intersect(kw.acronyms, cw.words)) > 0 THEN 'acronym match' ELSE 'no shared terms' END AS title,
    CASE WHEN cw.place IS NULL OR kw.place IS NULL THEN 'location unknown on one side' WHEN cw.place = kw.place THEN 'same location' WHEN contains(cw.place, kw.place) OR contains(kw.place, cw.place) THEN 'one location contains the other'
      WHEN len(list_intersect(cw.place_words, kw.place_words)) > 0 THEN 'locations share ' || array_to_string(list_sort(list_distinct(list_intersect(cw.place_words, kw.place_words))), ', ') ELSE 'locations differ' END
    || '; ' || CASE WHEN kw.place IS NULL THEN 'modality unknown' WHEN (lower(cw.meeting_type) = 'virtual') = kw.virtual THEN 'modality agrees' ELSE cw.meeting_type || ' vs ' || CASE WHEN kw.virtual THEN 'virtual' ELSE 'physical' END || ' location' END AS structure
  FROM pairs JOIN p USING (c_id, k_id) JOIN cw USING (c_id) JOIN kw USING (k_id) JOIN crm_c c ON c.crm_id = c_id JOIN cal_c k ON k.event_id = k_id
)
"""

_CODES = ", ".join(f"('{c}', '{s}')" for c, (s, _) in FLAG_CODES.items())


def _census(source: str, raw: str, fields: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (WHERE {f} IS NULL OR CAST({f} AS STRING) = '') AS n_gaps, count(*) AS n_rows, '{source}' AS source FROM {raw}" for f in fields)


_title = "c_mktsegment || ' LP Advisory Committee for the ' || c_name"

# Field -> raw keys, for every field that two sources can have.
_SOURCE_KEYS = "('title', 'crm', 'subject'), ('title', 'calendar', 'title'), ('end_time', 'calendar', 'end_time'), ('participants', 'crm', 'client_name'), ('participants', 'calendar', 'attendees'), ('participants', 'calendar', 'organizer'), ('client_name', 'crm', 'client_name'), ('client_company', 'crm', 'client_company'), ('owner_name', 'crm', 'relationship_owner'), ('owner_name', 'calendar', 'organizer'), ('meeting_type', 'crm', 'meeting_type'), ('notes', 'crm', 'notes'), ('notes', 'calendar', 'description'), ('start_time', 'crm', 'meeting_date'), ('start_time', 'crm', 'meeting_time'), ('start_time', 'calendar', 'start_time'), ('location', 'crm', 'location'), ('location', 'calendar', 'location'), ('status', 'crm', 'status'), ('status', 'calendar', 'status')"

ORACLE_SQL: dict[str, str] = {
    "rec_crm_normalized": f"""WITH {_BASE}
SELECT crm_id AS source_id, CAST(event_date AS STRING) AS event_date, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, client AS client_name, client_company, st AS status,
  CASE WHEN client IS NULL THEN 1 ELSE 2 END AS n_participants, array_to_string(flags, ',') AS flags FROM crm_n JOIN crm_flags ON source_id = crm_id""",
    "rec_calendar_normalized": f"""WITH {_BASE}
SELECT event_id AS source_id, CAST(event_date AS STRING) AS event_date, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(end_at, '%Y-%m-%d %H:%M:%S') AS "end", is_recurring, status,
  array_to_string(list_transform(once, lambda p: concat_ws('/', coalesce(p.email, p.raw), split_part(p.email, '@', 2), CAST(p.email IS NOT NULL AND p.email = organizer AS STRING))), ',') AS participants,
  array_to_string(flags, ',') AS flags FROM cal_people JOIN cal_flags ON source_id = event_id""",
    "rec_flags_by_code": f"""WITH {_BASE}
SELECT code, severity, count(*) AS n FROM flags JOIN (VALUES {_CODES}) v(code, severity) ON code = split_part(f, ':', 1) GROUP BY ALL""",
    "rec_flags_by_severity": f"""WITH {_BASE}
SELECT severity, count(*) AS n FROM flags JOIN (VALUES {_CODES}) v(code, severity) ON code = split_part(f, ':', 1) GROUP BY ALL""",
    "rec_records_in": f"WITH {_BASE} SELECT 'crm' AS source, count(*) AS records FROM crm_raw UNION ALL SELECT 'calendar', count(*) FROM cal_raw",
    "rec_status_vocabulary": f"WITH {_BASE} SELECT DISTINCT 'crm' AS source, status AS status_raw FROM crm_raw UNION ALL SELECT DISTINCT 'calendar', status FROM cal_raw",
    "rec_gap_census": f"WITH {_BASE} {_census('crm', 'crm_raw', CRM_FIELDS)} UNION ALL {_census('calendar', 'cal_raw', CALENDAR_FIELDS)}",
    "rec_text_functions": f"""
SELECT c_custkey, array_to_string({_tokens(_title)}, ' ') AS tokens, {_key("c_name")} AS name_key, {_key("c_name")} AS email_key,
  starts_with(lower(left(c_mktsegment, 5)) || 'vc', lower(c_mktsegment)) OR starts_with(lower(c_mktsegment), lower(left(c_mktsegment, 5)) || 'vc') AS prefix_match,
  true AS initials_match, false AS no_match, array_to_string(list_sort({_content(_title)}), ' ') AS content,
  len({_acronyms(_tokens(_title))}) AS n_acronyms, list_contains({_acronyms(_tokens(_title))}, 'lpac') AS has_lpac, 'x.com' AS domain
FROM customer""",
    "rec_candidate_pairs": f"""WITH {_BASE}, {_PAIRS}
SELECT c_id, k_id, round(participants, 6) AS participants, round(time, 6) AS time, round(title, 6) AS title, round(structure, 6) AS structure, round(score, 6) AS score,
  CASE WHEN score >= 0.7 THEN 'high' ELSE 'low' END AS confidence FROM found""",
    "rec_candidate_pairs_pruned": f"WITH {_BASE}, {_PAIRS} SELECT c_id, k_id, round(score, 6) AS score FROM found",
    "rec_assignment": f"WITH {_BASE}, {_PAIRS}, {_greedy()} SELECT c_id, k_id, round(score, 6) AS score FROM pairs",
    "rec_unmatched_records": f"""WITH {_BASE}, {_PAIRS}, {_greedy()}
SELECT 'crm' AS source, crm_id AS source_id FROM crm_raw WHERE crm_id NOT IN (SELECT c_id FROM pairs)
UNION ALL SELECT 'calendar', event_id FROM cal_raw WHERE event_id NOT IN (SELECT k_id FROM pairs)""",
    "rec_duplicates": f"WITH {_BASE}, {_COLLAPSED} SELECT 'calendar' AS source, dup AS source_id, survivor FROM joined UNION ALL SELECT 'crm', dup, survivor FROM crm_joined",
    "rec_duplicate_count": f"WITH {_BASE}, {_COLLAPSED} SELECT (SELECT count(*) FROM joined) + (SELECT count(*) FROM crm_joined) AS duplicates_collapsed",
    "rec_collapsed": f"""WITH {_BASE}, {_COLLAPSED}
SELECT 'calendar' AS source, ids AS source_ids, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, len(once) AS n_participants, 2 AS n_raw, true AS flagged FROM cal_c WHERE dup IS NOT NULL
UNION ALL SELECT 'crm', ids, strftime(start, '%Y-%m-%d %H:%M:%S'), CASE WHEN client IS NULL THEN 1 ELSE 2 END, 2, true FROM crm_c WHERE dup IS NOT NULL""",
    "rec_merged_fields": f"""WITH {_WHOLE}
SELECT id, origin, strftime(st_value, '%Y-%m-%d %H:%M:%S') AS start_time, st_source AS start_time_source, st_kind AS start_time_kind, st_others AS start_time_others,
  loc_value AS location, loc_source AS location_source, loc_kind AS location_kind, loc_others AS location_others, status_value AS status, status_source, status_kind, status_others,
  owner AS owner_name, owner_source AS owner_name_source, NULL::STRING AS owner_name_kind, owner_others AS owner_name_others FROM meetings""",
    "rec_conflict_kinds": f"WITH {_WHOLE} SELECT kind, count(*) AS n FROM kinds WHERE kind IS NOT NULL GROUP BY kind",
    "rec_conflict_fields": f"WITH {_WHOLE} SELECT field, count(*) AS n FROM kinds WHERE kind = 'contradiction' GROUP BY field",
    "rec_conflict_report": f"WITH {_WHOLE} SELECT field, id FROM kinds WHERE kind = 'contradiction'",
    "rec_chronological": f"WITH {_WHOLE} SELECT id, CAST(event_date AS STRING) AS event_date, strftime(start, '%Y-%m-%d %H:%M:%S') AS start FROM meetings",
    "rec_published_list": f"WITH {_WHOLE} SELECT id, origin FROM meetings",
    "rec_filtered_list": f"""WITH {_WHOLE}
SELECT id, owner FROM meetings WHERE origin = 'both' AND (owner = 'Priya Sharma' OR organizer = 'priya.sharma@firma.com') AND event_date BETWEEN DATE '1993-01-01' AND DATE '1996-12-31'
  AND id IN (SELECT id FROM kinds WHERE kind = 'contradiction')""",
    "rec_signal_contributions": f"""WITH {_TO_PAIRS}
SELECT c_id, k_id, unnest(['participants', 'time', 'title', 'structure']) AS signal,
  unnest([round(0.4::DOUBLE * participants, 6), round(0.3::DOUBLE * time, 6), round(0.2::DOUBLE * title, 6), round(0.1::DOUBLE * structure, 6)]) AS contribution
FROM found SEMI JOIN pairs USING (c_id, k_id)""",
    "rec_meeting_states": f"""WITH {_WHOLE}
SELECT id, coalesce(c.fields, '') AS conflict_fields, c.fields IS NOT NULL AS has_conflicts, f.worst AS worst_severity, f.n::BIGINT AS n_flags FROM meetings
LEFT JOIN (SELECT id, string_agg(field, ',' ORDER BY list_position(['start_time', 'location', 'status'], field)) AS fields FROM kinds WHERE kind = 'contradiction' GROUP BY id) c USING (id)
LEFT JOIN (SELECT id, sum(n) AS n, ['info', 'warning', 'error'][max(list_position(['info', 'warning', 'error'], v.severity))] AS worst FROM meeting_flags JOIN (VALUES {_CODES}) v(code, severity) USING (code) GROUP BY id) f USING (id)""",
    "rec_flag_report": f"""WITH {_WHOLE}, once_each AS (SELECT DISTINCT code, id, event_date, start FROM meeting_flags JOIN meetings USING (id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY event_date NULLS LAST, start NULLS FIRST, id) AS r FROM once_each)
SELECT code, v.severity, n.n::BIGINT AS n_flags, m.n AS n_meetings, m.ids AS first_ids, greatest(m.n - 6, 0) AS more
FROM (SELECT code, sum(n) AS n FROM meeting_flags GROUP BY code) n
JOIN (SELECT code, count(*) AS n, string_agg(id, ',' ORDER BY r) FILTER (WHERE r <= 6) AS ids FROM placed GROUP BY code) m USING (code) JOIN (VALUES {_CODES}) v(code, severity) USING (code)""",
    "rec_match_details": f"""WITH {_TO_PAIRS}, {_DETAILS}
SELECT id, unnest(['participants', 'time', 'title', 'structure']) AS signal, unnest([participants, time, title, structure]) AS detail FROM told""",
    "rec_merged_values": f"""WITH {_TO_PAIRS}, {_SIDES}
SELECT id, {_preferred("title", "subject", "crm", "title", "calendar")}, {_preferred("client_name", "client", "crm", _none, "calendar")}, {_preferred("client_company", "client_company", "crm", _none, "calendar")},
  {_preferred("meeting_type", "meeting_type", "crm", _none, "calendar")}, {_preferred("notes", "cn", "crm", "kn", "calendar")}, {_preferred("end_time", _end, "calendar", _none, "crm")},
  {_preferred("participants", "listed", "calendar", _people_crm, "crm")} FROM sides""",
    "rec_published_period": f"WITH {_WHOLE} SELECT id, CAST(event_date AS STRING) AS event_date FROM meetings WHERE event_date BETWEEN DATE '1995-01-15' AND DATE '1995-03-20'",
    "rec_meeting_detail": f"""WITH {_TO_PAIRS}, {_SIDES}, last AS (SELECT max(id) AS id FROM sides WHERE crm_id IS NOT NULL AND event_id IS NOT NULL)
SELECT id, 'both' AS origin, sides.subject AS title, len(string_split(id, 'crm-')) - 1 AS n_crm, len(string_split(id, 'cal-')) - 1 AS n_calendar, crm_c.notes AS raw_notes FROM last JOIN sides USING (id) JOIN crm_c USING (crm_id)""",
    "rec_sources": f"""WITH {_BASE}
SELECT kind, source, source_id, n_participants, n_flags, raw_location_chars FROM (VALUES ('lines'), ('array'), ('split'), ('parquet')) v(kind), (
  SELECT 'crm' AS source, crm_id AS source_id, CASE WHEN client IS NULL THEN 1 ELSE 2 END AS n_participants, len(flags) AS n_flags, length(location) AS raw_location_chars FROM crm_n JOIN crm_flags ON source_id = crm_id
  UNION ALL SELECT 'calendar', event_id, len(once), len(flags), length(location) FROM cal_people JOIN cal_flags ON source_id = event_id)""",
    "rec_broken_integrity": f"""WITH {_WHOLE}, year AS (SELECT * FROM meetings WHERE year(event_date) = 1995)
SELECT 'origin' AS "check", count(*) FILTER (WHERE origin <> 'crm_only') AS n_violations FROM year
UNION ALL SELECT 'score', count(*) FROM year WHERE origin = 'both' UNION ALL SELECT 'conflict', count(*) FROM year UNION ALL SELECT 'date', count(*) FROM year WHERE start IS NOT NULL
UNION ALL SELECT 'event_date', (SELECT count(*) FROM crm_n WHERE year(event_date) = 1995 AND start IS NOT NULL) + (SELECT count(*) FROM cal_people WHERE year(event_date) = 1995)
UNION ALL SELECT 'ids', count(*) FROM year UNION ALL SELECT 'conservation', coalesce(sum(len(string_split(id, 'crm-')) + len(string_split(id, 'cal-')) - 2), 0)::BIGINT FROM year""",
    "rec_published_owner": f"""WITH {_WHOLE}
SELECT id, owner FROM meetings WHERE contains({_key("split_part(owner, '@', 1)")}, 'priyasharma') OR contains({_key("split_part(organizer, '@', 1)")}, 'priyasharma')""",
    "rec_rejected_runs": f"""WITH {_WHOLE}, year AS (SELECT * FROM meetings WHERE year(event_date) = 1995)
SELECT * FROM (
  SELECT 'origin' AS spoiled, 'origin' AS "check", count(*) FILTER (WHERE origin <> 'crm_only') AS n FROM year UNION ALL SELECT 'score', 'score', count(*) FROM year WHERE origin = 'both'
  UNION ALL SELECT 'date', 'date', count(*) FROM year WHERE start IS NOT NULL UNION ALL SELECT 'conservation', 'conservation', coalesce(sum(len(string_split(id, 'crm-')) + len(string_split(id, 'cal-')) - 2), 0)::BIGINT FROM year
) WHERE n > 0 UNION ALL SELECT 'none', 'readable', count(*) FROM meetings""",
    "rec_timestamp_shapes": """WITH e AS (SELECT event_id, event_id % 12 AS k, date_trunc('second', ts::TIMESTAMP) AS wall FROM events), s AS (
  SELECT *, CASE WHEN k = 2 THEN wall + INTERVAL 500000 MICROSECOND WHEN k = 3 THEN wall + INTERVAL 123456 MICROSECOND WHEN k = 9 THEN date_trunc('minute', wall) ELSE wall END AS told,
    CASE k WHEN 5 THEN 0 WHEN 8 THEN 0 WHEN 6 THEN 19815 WHEN 7 THEN -12600 END AS shift FROM e
), l AS (
  SELECT *, CASE WHEN shift IS NOT NULL THEN ((told - to_seconds(shift)) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' WHEN k < 10 THEN told END AS t FROM s
)
SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS t, CASE WHEN k >= 9 THEN 'MALFORMED_DATETIME' WHEN shift IS NULL THEN 'TIMEZONE_ASSUMED' END AS t_code,
  CAST(CASE WHEN k = 9 THEN CAST(date_trunc('week', wall) AS DATE) ELSE CAST(wall AS DATE) END AS STRING) AS d, NULL::STRING AS d_code FROM l""",
    "rec_integrity": "SELECT unnest(['origin', 'score', 'conflict', 'date', 'event_date', 'ids', 'conservation']) AS \"check\", 0 AS n_violations",
    "rec_conflict_keys": f"""WITH {_WHOLE}
SELECT DISTINCT id, source, "key" FROM kinds JOIN (VALUES {_SOURCE_KEYS}) v(field, source, "key") USING (field) WHERE kind = 'contradiction'""",
    "rec_run_summary": f"""WITH {_WHOLE}
SELECT 'meetings_out' AS metric, NULL::STRING AS "key", count(*)::BIGINT AS "count" FROM meetings
UNION ALL SELECT 'matched_pairs', NULL, count(*) FROM meetings WHERE origin = 'both' UNION ALL SELECT origin, NULL, count(*) FROM meetings WHERE origin <> 'both' GROUP BY origin
UNION ALL SELECT 'low_confidence', NULL, count(*) FROM pairs WHERE score < 0.7
UNION ALL SELECT 'duplicates_collapsed', NULL, (SELECT count(*) FROM joined) + (SELECT count(*) FROM crm_joined)
UNION ALL SELECT 'records_in', 'crm', count(*) FROM crm_raw UNION ALL SELECT 'records_in', 'calendar', count(*) FROM cal_raw
UNION ALL SELECT 'conflicts_by_kind', kind, count(*) FROM kinds WHERE kind IS NOT NULL GROUP BY kind
UNION ALL SELECT 'conflicts_by_field', field, count(*) FROM kinds WHERE kind = 'contradiction' GROUP BY field
UNION ALL SELECT 'flags_by_code', code, sum(n)::BIGINT FROM meeting_flags GROUP BY code
UNION ALL SELECT 'flags_by_severity', severity, sum(n)::BIGINT FROM meeting_flags JOIN (VALUES {_CODES}) v(code, severity) USING (code) GROUP BY severity""",
}
ORACLE_SQL["rec_published_summary"] = ORACLE_SQL["rec_run_summary"]
