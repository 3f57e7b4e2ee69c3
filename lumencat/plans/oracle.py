"""SQL over the driver tables that each query must agree with."""

from __future__ import annotations

from lumencat.functions import stemming
from lumencat.functions.text import ENGLISH_STOP_WORDS

# Shared sub-queries.
_ASSETS = """assets AS (
  SELECT o_orderkey AS id, o_orderstatus AS asset_type, o_orderpriority AS file_name,
         '/' || o_orderstatus || '/' || o_orderkey AS file_path,
         CAST(round(o_totalprice * 100) AS BIGINT) AS file_size, o_orderdate AS created_at,
         CAST((o_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS lon,
         CAST((o_custkey * 104729) % 17800 AS DOUBLE) / 100 - 89 AS lat
  FROM orders)"""
_DIMENSIONS = "dims AS (SELECT doc_id AS asset_id, quality AS width, toxic AS height FROM labels)"
_METADATA = """meta AS (
  SELECT event_id AS asset_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
_TAGS = "tags AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name)"
_NAMED = "named AS (SELECT l_orderkey AS asset_id, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey)"
_LINKS = f"{_TAGS}, {_NAMED}, links AS (SELECT DISTINCT asset_id, id AS tag_id FROM named JOIN tags USING (name))"
_TAG_LISTS = f"{_LINKS}, lists AS (SELECT asset_id, list_sort(list(DISTINCT name)) AS names FROM named GROUP BY 1)"
_SNAPSHOTS = f"""{_ASSETS},
old AS (SELECT id, asset_type, file_name, file_size FROM assets WHERE created_at < TIMESTAMP '2000-07-01'),
sums AS (SELECT l_orderkey AS id, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1),
new AS (
  SELECT a.id, CASE WHEN q > 200 THEN 'P' ELSE asset_type END AS asset_type, file_name,
         CAST(CASE WHEN (CASE WHEN q > 200 THEN 'P' ELSE asset_type END) = 'F' AND q IS NOT NULL
              THEN q ELSE file_size END AS BIGINT) AS file_size
  FROM assets a LEFT JOIN sums ON sums.id = a.id WHERE created_at >= TIMESTAMP '1996-01-01')"""
_CHANGES = f"""{_SNAPSHOTS},
pairs AS (
  SELECT coalesce(n.id, o.id) AS record_id, o.id IS NOT NULL AS had, n.id IS NOT NULL AS has,
         o.asset_type AS old_type, o.file_size AS old_size, n.asset_type AS new_type, n.file_size AS new_size
  FROM old o FULL OUTER JOIN new n ON o.id = n.id),
changes AS (
  SELECT *, CASE WHEN NOT had THEN 'INSERT' WHEN NOT has THEN 'DELETE' ELSE 'UPDATE' END AS action
  FROM pairs WHERE had <> has OR old_type <> new_type OR old_size <> new_size)"""
_IMAGE_COLUMNS = """record_id, action, 'assets' AS table_name, '{at}' AS changed_at,
  old_type, old_size, new_type, new_size"""
_AS_OF = "2024-01-16 00:00:00"
_LOG = f"""{_CHANGES},
first AS (
  SELECT id AS record_id, 'INSERT' AS action, 'assets' AS table_name, '2024-01-01 00:00:00' AS changed_at,
         CAST(NULL AS VARCHAR) AS old_type, CAST(NULL AS BIGINT) AS old_size, asset_type AS new_type,
         file_size AS new_size, row_number() OVER (ORDER BY id) AS id FROM old),
log AS (
  SELECT * FROM first UNION ALL
  SELECT {_IMAGE_COLUMNS.format(at=_AS_OF)},
         row_number() OVER (ORDER BY record_id) + (SELECT count(*) FROM old) AS id FROM changes)"""
_PLACES = """places AS (
  SELECT c_custkey AS id, c_name AS file_name, CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS lon,
         CAST((c_custkey * 104729) % 17800 AS DOUBLE) / 100 - 89 AS lat FROM customer)"""
_CENTRES = """centres AS (
  SELECT s_suppkey AS centre_id,
         CAST(((s_suppkey * 31 + 7) * 7919) % 36000 AS DOUBLE) / 100 - 180 + 0.123::DOUBLE AS clon,
         CAST(((s_suppkey * 31 + 7) * 104729) % 17800 AS DOUBLE) / 100 - 89 + 0.057::DOUBLE AS clat FROM supplier)"""


def _haversine(lon: str, lat: str) -> str:
    return (
        f"2 * 6371008.8::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({lat} - lat) / 2), 2) + "
        f"cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lon} - lon) / 2), 2))))"
    )


def _planar(lon: str, lat: str) -> str:
    return f"sqrt((lon - {lon}) * (lon - {lon}) + (lat - {lat}) * (lat - {lat}))"


_CENTRE = ("10.25::DOUBLE", "48.5::DOUBLE")


def _split(text: str) -> str:
    return rf"regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+')"


_POSTINGS = f"""texts AS (
  SELECT doc_id AS id, 'A' AS weight, text FROM documents UNION ALL
  SELECT doc_id, 'B', lang || ' ' || source FROM documents),
words AS (SELECT id, weight, unnest({_split('text')}) AS term FROM texts),
postings AS (SELECT id, weight, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY ALL)"""
_CATALOG_POSTINGS = f"""{_ASSETS}, {_TAG_LISTS},
words AS (
  SELECT id, 'A' AS weight, unnest({_split('file_name')}) AS term FROM assets UNION ALL
  SELECT asset_id, 'B', unnest({_split('name')}) FROM links JOIN tags ON tags.id = tag_id),
postings AS (SELECT id, weight, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY ALL)"""
_BY_SCORE = "row_number() OVER (ORDER BY score DESC, id) AS rank"


def _mapped(value: str, choices: dict[str, str]) -> str:
    return f"CASE {value} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in choices.items())} END"


def _step(n: int, rules, inside: str, r: str) -> str:
    """One step of suffixes: the longest one is replaced if what is left reaches into the region."""
    new = _mapped("s", rules) if isinstance(rules, dict) else "''"
    return f"""d{n}a AS (SELECT *, regexp_extract(w, '({'|'.join(rules)})$') AS s FROM d{n - 1}),
d{n} AS (SELECT term, done, r1, r2, CASE WHEN s <> '' AND length(w) - length(s) >= {r} AND ({inside})
  THEN left(w, length(w) - length(s)) || {new} ELSE w END AS w FROM d{n}a)"""


# Stop words out, a dictionary of stems by the published steps, and words of one stem added up.
_ENGLISH = f"""{_POSTINGS},
d0 AS (SELECT term, CASE WHEN length(term) < 3 THEN term ELSE {_mapped('term', stemming.WHOLE)} END AS done,
  regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') AS w
  FROM (SELECT DISTINCT term FROM postings WHERE term NOT IN ({', '.join(f"'{x}'" for x in ENGLISH_STOP_WORDS)}))),
d1a AS (SELECT *, CASE {' '.join(f"WHEN starts_with(w, '{x}') THEN {len(x)}" for x in stemming.LONG_PREFIXES)}
  ELSE coalesce(nullif(length(regexp_extract(w, '{stemming.REGION}')), 0), length(w)) END AS r1 FROM d0),
d1b AS (SELECT *, r1 + coalesce(nullif(length(regexp_extract(substr(w, r1 + 1), '{stemming.REGION}')), 0), length(w) - r1) AS r2 FROM d1a),
d1c AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2)
  WHEN regexp_matches(w, '(ied|ies)$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
  WHEN regexp_matches(w, '[us]s$') OR NOT ends_with(w, 's') OR NOT regexp_matches(left(w, length(w) - 2), '[aeiouy]') THEN w
  ELSE left(w, length(w) - 1) END AS w) FROM d1b),
d1d AS (SELECT * REPLACE (coalesce(done, CASE WHEN lower(w) IN {stemming.KEPT_AFTER_PLURAL} THEN lower(w) END) AS done),
  coalesce(nullif(regexp_extract(w, '(eedly|eed)$'), ''), regexp_extract(w, '(ingly|edly|ing|ed)$')) AS s FROM d1c),
d1e AS (SELECT *, left(w, length(w) - length(s)) AS x FROM d1d),
d1f AS (SELECT term, done, r1, r2, CASE WHEN s = '' THEN w
  WHEN starts_with(s, 'eed') THEN CASE WHEN length(x) >= r1 THEN x || 'ee' ELSE w END
  WHEN NOT regexp_matches(x, '[aeiouy]') THEN w WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e'
  WHEN regexp_matches(x, '{stemming.DOUBLE}') THEN left(x, length(x) - 1)
  WHEN r1 >= length(x) AND regexp_matches(x, '{stemming.SHORT}') THEN x || 'e' ELSE x END AS w FROM d1e),
d1 AS (SELECT * REPLACE (regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') AS w) FROM d1f),
{_step(2, stemming.STEP_2, "(s <> 'ogi' OR regexp_matches(w, 'logi$')) AND (s <> 'li' OR regexp_matches(w, '[cdeghkmnrt]li$'))", 'r1')},
{_step(3, stemming.STEP_3, "s <> 'ative' OR length(w) - 5 >= r2", 'r1')},
{_step(4, stemming.STEP_4, "s <> 'ion' OR regexp_matches(w, '[st]ion$')", 'r2')},
d5 AS (SELECT *, left(w, length(w) - 1) AS x FROM d4),
stems AS (SELECT term, coalesce(done, lower(CASE
  WHEN ends_with(w, 'e') AND (length(x) >= r2 OR length(x) >= r1 AND NOT regexp_matches(x, '{stemming.SHORT}')) THEN x
  WHEN ends_with(w, 'll') AND length(x) >= r2 THEN x ELSE w END)) AS stem FROM d5),
english AS (SELECT id, weight, stem AS term, CAST(sum(tf) AS BIGINT) AS tf FROM postings JOIN stems USING (term) GROUP BY ALL)"""
_PART = "(CASE weight WHEN 'A' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) * tf / (tf + 1.0::DOUBLE)"
_PUTS = """puts AS (
  SELECT CAST(user_id AS VARCHAR) AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts AS write_ts,
         event_id AS seq,
         CASE WHEN event_type <> 'error' THEN ts + to_hours(CAST(floor(value) AS INTEGER)) END AS expires_at
  FROM events)"""
_NEWEST = "SELECT * FROM puts {where} QUALIFY row_number() OVER (PARTITION BY key ORDER BY write_ts DESC, seq DESC) = 1"
_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_MESSAGES = """messages AS (
  SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'processing' ELSE 'pending' END AS status, ts AS created_at,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
_RECORDS = """records AS (
  SELECT d.doc_id, lang, source, n_chars, quality, toxic,
         (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY d.doc_id) AS asset_id
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_RECORD_TAGS = f"""{_TAGS}, {_RECORDS},
wanted AS (SELECT asset_id, lang AS name FROM records UNION SELECT asset_id, source FROM records),
created AS (
  SELECT (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY name) AS id, name
  FROM (SELECT DISTINCT name FROM wanted WHERE name NOT IN (SELECT name FROM tags)))"""


def _dq(rule: str, table: str, columns: str, value: str, n: str, source: str) -> str:
    return (
        f"SELECT '{rule}' AS rule, '{table}' AS table_name, '{columns}' AS columns, "
        f"CAST({value} AS VARCHAR) AS value, CAST({n} AS BIGINT) AS row_count FROM {source}"
    )


_DETAILS = """SELECT a.id, asset_type, file_name, {path}file_size, width, height,
       coalesce(array_to_string(names, ','), '') AS tags, k
FROM assets a LEFT JOIN dims d ON d.asset_id = a.id LEFT JOIN lists t ON t.asset_id = a.id
LEFT JOIN meta m ON m.asset_id = a.id"""

# The folded patches of the sides: own event first, then the height of the event before, if it has one.
_SIDES = """sides AS (
  SELECT coalesce(e.event_id, l.event_id + 1) AS id, coalesce(e.event_type <> 'view', false) AS has_width,
    coalesce(e.event_id IS NOT NULL OR l.event_id IS NOT NULL, false) AS has_height, e.user_id,
    CASE WHEN e.event_type = 'click' THEN e.user_id END AS width,
    CASE WHEN l.event_id IS NOT NULL THEN CAST(floor(l.value) AS INTEGER) WHEN e.event_type <> 'error' THEN CAST(floor(e.value) AS INTEGER) END AS height,
    CASE WHEN e.event_type = 'click' THEN CAST(json_extract(e.props, '$.k') AS BIGINT) END AS k
  FROM events e FULL JOIN (SELECT * FROM events WHERE event_type <> 'error') l ON l.event_id + 1 = e.event_id
  WHERE coalesce(e.event_id, l.event_id + 1) IN (SELECT id FROM assets))"""

ORACLE: dict[str, str] = {
    # A
    "scan_assets": f"""WITH {_ASSETS} SELECT id, asset_type, file_name, file_path, file_size,
        {_TIME.format('created_at')} AS created_at, round(lon, 2) AS lon, round(lat, 2) AS lat FROM assets""",
    "insert_assets": f"""SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) AS id,
        c_mktsegment AS asset_type, c_name AS file_name, '/' || c_mktsegment || '/' || c_name AS file_path,
        CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS file_size, '{_AS_OF}' AS created_at, '{_AS_OF}' AS updated_at
        FROM customer""",
    "ingest_assets": f"""WITH {_RECORDS} SELECT asset_id AS id, lang AS asset_type, source || '-' || doc_id AS file_name,
        '/' || lang || '/' || source || '/' || doc_id AS file_path, n_chars AS file_size, '{_AS_OF}' AS created_at,
        round(CAST((doc_id * 7919) % 36000 AS DOUBLE) / 100 - 180, 2) AS lon,
        round(CAST((doc_id * 104729) % 17800 AS DOUBLE) / 100 - 89, 2) AS lat FROM records""",
    "ingest_dimensions": f"""WITH {_RECORDS} SELECT asset_id, quality AS width, toxic AS height FROM records
        WHERE quality IS NOT NULL""",
    "ingest_tags": f"WITH {_RECORD_TAGS} SELECT id, name FROM created",
    "ingest_asset_tags": f"""WITH {_RECORD_TAGS} SELECT asset_id, coalesce(t.id, c.id) AS tag_id
        FROM wanted w LEFT JOIN tags t ON t.name = w.name LEFT JOIN created c ON c.name = w.name""",
    "ingest_metadata": f"WITH {_RECORDS} SELECT asset_id, lang, n_chars FROM records WHERE quality = 1",
    "ingest_rejected_locations": """SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY event_id) AS asset_id,
        value AS latitude, CAST(user_id - 60 AS DOUBLE) AS longitude FROM events
        QUALIFY NOT (value BETWEEN -90 AND 90 AND user_id - 60 BETWEEN -180 AND 180)""",
    "write_job_audit": f"""WITH {_RECORDS} SELECT asset_id AS record_id, 'INSERT' AS action, 'assets' AS table_name,
        '{_AS_OF}' AS changed_at, CAST(NULL AS VARCHAR) AS old_type, CAST(NULL AS BIGINT) AS old_size, lang AS new_type,
        n_chars AS new_size FROM records""",
    "write_job_counts": f"""WITH {_ASSETS} SELECT asset_type, count(*) AS "count" FROM (
        SELECT asset_type FROM assets UNION ALL SELECT lang FROM documents) GROUP BY asset_type""",
    "write_job_postings": f"""WITH {_RECORDS} SELECT id, weight, term, count(*) AS tf FROM (
        SELECT asset_id AS id, 'A' AS weight, unnest([lower(source), CAST(doc_id AS VARCHAR)]) AS term FROM records
        UNION ALL SELECT asset_id, 'B', unnest([lower(source), lower(lang)]) FROM records) GROUP BY ALL""",
    "point_build": """SELECT event_id,
        CASE WHEN value BETWEEN -90 AND 90 AND user_id * 2 - 100 BETWEEN -180 AND 180
             THEN CAST(user_id * 2 - 100 AS DOUBLE) END AS lon,
        CASE WHEN value BETWEEN -90 AND 90 AND user_id * 2 - 100 BETWEEN -180 AND 180 THEN value END AS lat
        FROM events""",
    # B
    "tag_get_or_create": f"""WITH {_TAGS}, names AS (
          SELECT p_name AS name FROM part UNION SELECT p_type FROM part UNION SELECT p_brand FROM part)
        SELECT id, name FROM tags UNION ALL
        SELECT (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY name), name FROM names
        WHERE name NOT IN (SELECT name FROM tags)""",
    "link_insert_or_ignore": "SELECT DISTINCT l_orderkey AS asset_id, l_partkey AS tag_id FROM lineitem",
    "link_rejects": f"""WITH {_SNAPSHOTS}, {_LINKS} SELECT asset_id, tag_id FROM links
        WHERE asset_id NOT IN (SELECT id FROM new)""",
    "add_tags": f"""WITH {_SNAPSHOTS}, {_LINKS} SELECT asset_id, tag_id FROM links
        WHERE asset_id IN (SELECT id FROM new) AND asset_id NOT IN (SELECT id FROM old)""",
    "patch_dimensions": f"""WITH {_ASSETS}, {_DIMENSIONS}, {_SIDES}
        , after AS (
          SELECT coalesce(d.asset_id, p.id) AS asset_id, d.width AS was_width, d.height AS was_height,
            CASE WHEN p.has_width THEN p.width ELSE d.width END AS width, CASE WHEN p.has_height THEN p.height ELSE d.height END AS height
          FROM dims d FULL JOIN sides p ON p.id = d.asset_id)
        SELECT asset_id, width, height, false AS rejected FROM after WHERE width IS NOT NULL AND height IS NOT NULL
        UNION ALL SELECT asset_id, was_width, was_height, false FROM after WHERE (width IS NULL) <> (height IS NULL) AND was_width IS NOT NULL
        UNION ALL SELECT asset_id, width, height, true FROM after WHERE (width IS NULL) <> (height IS NULL)""",
    "patch_metadata": f"""WITH {_ASSETS}, {_METADATA}, {_SIDES}
        SELECT * FROM (SELECT coalesce(m.asset_id, p.id) AS asset_id, CASE WHEN p.has_width THEN p.k ELSE m.k END AS k
          FROM meta m FULL JOIN sides p ON p.id = m.asset_id) WHERE k IS NOT NULL""",
    "patch_tags": f"""WITH {_ASSETS}, {_LINKS}, {_SIDES}
        SELECT asset_id, name FROM links JOIN tags ON tags.id = tag_id
        WHERE asset_id NOT IN (SELECT id FROM sides WHERE has_width)
        UNION ALL SELECT id, unnest(['user ' || user_id, 'click']) FROM sides WHERE width IS NOT NULL""",
    "asset_records": f"""WITH {_ASSETS}, {_DIMENSIONS}, {_METADATA}, {_TAG_LISTS}
        SELECT a.id, asset_type, file_name, round(lat, 2) AS latitude, round(lon, 2) AS longitude, width, height,
          coalesce(array_to_string(names, ','), '') AS tags, k
        FROM (SELECT * FROM assets ORDER BY id LIMIT 100 OFFSET 200) a LEFT JOIN dims d ON d.asset_id = a.id
        LEFT JOIN lists t ON t.asset_id = a.id LEFT JOIN meta m ON m.asset_id = a.id""",
    "patch_assets": f"""WITH {_ASSETS}
        SELECT a.id, asset_type,
               CASE WHEN d.doc_id IS NOT NULL THEN d.source WHEN event_type = 'click' THEN event_type
                    ELSE file_name END AS file_name,
               CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) ELSE file_size END AS file_size,
               CASE WHEN event_id IS NOT NULL OR d.doc_id IS NOT NULL THEN '{_AS_OF}'
                    ELSE {_TIME.format('created_at')} END AS updated_at,
               CASE WHEN event_type IS DISTINCT FROM 'error' THEN round(lon, 2) END AS lon,
               CASE WHEN event_type IS DISTINCT FROM 'error' THEN round(lat, 2) END AS lat
        FROM assets a LEFT JOIN events ON event_id = a.id LEFT JOIN documents d ON d.doc_id = a.id""",
    "delete_returning": f"""WITH {_ASSETS} SELECT id, asset_type, file_name, file_size FROM assets
        WHERE id IN (SELECT event_id FROM events WHERE event_type = 'error')""",
    "delete_keeping": f"""WITH {_ASSETS} SELECT id, asset_type FROM assets
        WHERE id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')""",
    "delete_restricted": f"""WITH {_ASSETS}, children AS (
          SELECT l_orderkey AS id FROM lineitem UNION SELECT event_id FROM events UNION SELECT doc_id FROM labels)
        SELECT id, CASE WHEN id IN (SELECT id FROM children) THEN 'blocked' ELSE 'deleted' END AS outcome
        FROM assets WHERE asset_type = 'F'""",
    "upsert_latest": f"""WITH {_PUTS} SELECT key, k, {_TIME.format('expires_at')} AS expires_at, seq
        FROM ({_NEWEST.format(where='')})""",
    # C
    "dq_primary_key": " UNION ALL ".join((
        _dq("primary_key", "lineitem", "l_orderkey,l_partkey", "l_orderkey || ',' || l_partkey", "count(*)",
            "lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1"),
        _dq("primary_key", "conversations", "conv_id,turn", "conv_id || ',' || turn", "count(*)",
            "conversations GROUP BY conv_id, turn HAVING count(*) > 1"),
    )),
    "dq_unique": _dq("unique", "part", "p_name", "p_name", "count(*)", "part GROUP BY p_name HAVING count(*) > 1"),
    "dq_not_null": f"""WITH {_ASSETS}, {_DIMENSIONS}, {_METADATA}, sides AS (
          SELECT a.id, file_name, width, height, m.asset_id AS metadata FROM assets a
          LEFT JOIN dims d ON d.asset_id = a.id LEFT JOIN meta m ON m.asset_id = a.id)
        SELECT * FROM (""" + " UNION ALL ".join(
            _dq("not_null", "asset_sides", c, "NULL", f"count(*) FILTER ({c} IS NULL)", "sides")
            for c in ("id", "file_name", "width", "height", "metadata")
        ) + ") WHERE row_count > 0",
    "dq_foreign_key": " UNION ALL ".join((
        _dq("foreign_key", "documents", "doc_id", "doc_id", "count(*)",
            "documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id"),
        _dq("foreign_key", "lineitem", "l_orderkey", "l_orderkey", "count(*)",
            "lineitem WHERE l_orderkey NOT IN (SELECT event_id FROM events) GROUP BY l_orderkey"),
    )),
    "dq_domain": " UNION ALL ".join((
        _dq("domain", "documents", "lang", "lang", "count(*)", "documents WHERE lang NOT IN ('en', 'fr') GROUP BY lang"),
        _dq("domain", "assets", "asset_type", "o_orderstatus", "count(*)",
            "orders WHERE o_orderstatus NOT IN ('image', 'video') GROUP BY o_orderstatus"),
    )),
    "dq_length": " UNION ALL ".join((
        _dq("max_length", "documents", "text", "length(text)", "count(*)",
            "documents WHERE length(text) > 255 GROUP BY length(text)"),
        _dq("max_length", "pages", "url", "length(url)", "count(*)", "pages WHERE length(url) > 50 GROUP BY length(url)"),
    )),
    "dq_shape": """SELECT event_id, 'asset_type' AS field FROM events WHERE event_type NOT IN ('click', 'view', 'error')
        UNION ALL SELECT event_id, 'file_path' FROM events WHERE event_type = 'view'
        UNION ALL SELECT event_id, 'location' FROM events
          WHERE value NOT BETWEEN -90 AND 90 OR user_id - 60 NOT BETWEEN -180 AND 180
        UNION ALL SELECT event_id, 'dimensions' FROM events WHERE value >= 200
        UNION ALL SELECT event_id, 'metadata' FROM events WHERE value < 20 OR value > 300""",
    "dq_catalog": _dq("domain", "assets", "asset_type", "o_orderstatus", "count(*)",
                      "orders WHERE o_orderstatus NOT IN ('image', 'video') GROUP BY o_orderstatus")
    + " UNION ALL " + _dq("foreign_key", "asset_dimensions", "asset_id", "doc_id", "count(*)",
                          "labels WHERE doc_id NOT IN (SELECT o_orderkey FROM orders) GROUP BY doc_id")
    + " UNION ALL " + _dq("foreign_key", "asset_metadata", "asset_id", "event_id", "count(*)",
                          "events WHERE event_id NOT IN (SELECT o_orderkey FROM orders) GROUP BY event_id"),
    "substring_batch": f"""WITH {_ASSETS}, {_LINKS}, words AS (
          SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT n_name FROM nation
            UNION ALL SELECT o_orderpriority FROM orders) WHERE name IS NOT NULL),
        patterns AS (SELECT DISTINCT unnest([substring(name, 3, 4), substring(name, 1, 2) || '%' || right(name, 2),
            substring(name, 1, 3) || '_' || substring(name, 5), upper(right(name, 5)), '', '___________', '%z%']) AS pattern FROM words),
        texts AS (SELECT DISTINCT file_name AS text FROM assets UNION SELECT asset_type FROM assets UNION SELECT name FROM tags),
        hits AS (SELECT pattern, text FROM patterns, texts WHERE text ILIKE '%' || pattern || '%'),
        found AS (
          SELECT pattern, id FROM hits JOIN assets ON file_name = text UNION SELECT pattern, id FROM hits JOIN assets ON asset_type = text
          UNION SELECT pattern, asset_id FROM hits JOIN tags ON name = text JOIN links ON tag_id = tags.id
            WHERE asset_id IN (SELECT id FROM assets))
        SELECT pattern, count(*) AS assets, CAST(sum(id) AS BIGINT) AS id_sum, min(id) AS first FROM found GROUP BY pattern""",
    "dq_incremental": f"""WITH {_LINKS}, assets AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
        dims AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic IS DISTINCT FROM 0) """
    + " UNION ALL ".join((
        _dq("domain", "assets", "asset_type", "o_orderstatus", "count(*)",
            "assets WHERE o_orderstatus NOT IN ('image', 'video') GROUP BY o_orderstatus"),
        _dq("primary_key", "asset_dimensions", "asset_id", "doc_id", "count(*)", "dims GROUP BY doc_id HAVING count(*) > 1"),
        _dq("foreign_key", "asset_dimensions", "asset_id", "doc_id", "count(*)",
            "dims WHERE doc_id NOT IN (SELECT o_orderkey FROM assets) GROUP BY doc_id"),
        _dq("foreign_key", "asset_metadata", "asset_id", "event_id", "count(*)",
            "events WHERE event_id NOT IN (SELECT o_orderkey FROM assets) GROUP BY event_id"),
        _dq("foreign_key", "asset_tags", "asset_id", "asset_id", "count(*)",
            "links WHERE asset_id NOT IN (SELECT o_orderkey FROM assets) GROUP BY asset_id"),
    )),
    # D
    "asset_details": f"WITH {_ASSETS}, {_DIMENSIONS}, {_METADATA}, {_TAG_LISTS} " + _DETAILS.format(path="file_path, "),
    "asset_lookup": f"WITH {_ASSETS} SELECT id, asset_type, file_name, file_size FROM assets WHERE id = 99",
    "asset_lookup_batch": f"""WITH {_ASSETS} SELECT p_partkey * 11 AS id, CAST(a.id IS NOT NULL AS INTEGER) AS found,
        asset_type, file_name FROM part LEFT JOIN assets a ON a.id = p_partkey * 11""",
    "page": f"""WITH {_ASSETS} SELECT *, row_number() OVER (ORDER BY id) AS rank FROM (
        SELECT id, asset_type, file_name FROM assets ORDER BY id LIMIT 100 OFFSET 200)""",
    "page_after": f"""WITH {_ASSETS} SELECT id, asset_type, file_name, row_number() OVER (ORDER BY id) AS rank
        FROM assets WHERE id > 700 ORDER BY id LIMIT 100""",
    **{
        name: f"""WITH {_ASSETS}, {_TAG_LISTS}, hits AS (
              SELECT DISTINCT asset_id FROM links JOIN tags ON tags.id = tag_id WHERE name ILIKE '%{text}%')
            SELECT id, asset_type, file_name FROM assets WHERE file_name ILIKE '%{text}%'
               OR asset_type ILIKE '%{text}%' OR id IN (SELECT asset_id FROM hits)"""
        for name, text in (
            ("substring_search", "ed"), ("substring_search_wildcard", "R_D b%T"), ("substring_search_literal", "-l"),
        )
    },
    "asset_json": f"""WITH {_ASSETS}, {_DIMENSIONS}, {_METADATA}, {_TAG_LISTS}
        SELECT a.id, asset_type AS type, file_name, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height,
               CAST(to_json(names) AS VARCHAR) AS tags, k,
               'id,type,file_name,dimensions,tags,metadata' AS members, 'width,height' AS dimension_members
        FROM assets a LEFT JOIN dims d ON d.asset_id = a.id LEFT JOIN lists t ON t.asset_id = a.id
        LEFT JOIN meta m ON m.asset_id = a.id""",
    "recent": f"""WITH {_MESSAGES} SELECT id, k, {_TIME.format('m.created_at')} AS created_at,
          row_number() OVER (ORDER BY m.created_at DESC NULLS FIRST, id DESC) AS rank FROM messages m
        ORDER BY m.created_at DESC NULLS FIRST, id DESC LIMIT 10""",
    "table_stats": "SELECT *, row_number() OVER (ORDER BY row_count DESC, table_name) AS rank FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                  "embeddings", "pages", "benchmark", "labels", "conversations")
    ) + ")",
    "metadata_contains": f"WITH {_METADATA} SELECT asset_id, k FROM meta WHERE k = 42",
    "metadata_contains_types": """WITH e AS (SELECT event_id AS id, event_id % 8 AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT * FROM (
        SELECT 0 AS test, id AS asset_id FROM e WHERE kind IN (0, 3) AND k = 42 UNION ALL SELECT 1, id FROM e WHERE kind = 1 AND k = 42
        UNION ALL SELECT 2, id FROM e WHERE kind = 2 AND k = 42 UNION ALL SELECT 3, id FROM e WHERE kind = 5
        UNION ALL SELECT 4, id FROM e WHERE kind = 4 AND k = 42 UNION ALL SELECT 5, id FROM e WHERE kind = 4
        UNION ALL SELECT 6, id FROM e WHERE kind = 4 UNION ALL SELECT 7, id FROM e WHERE kind = 4 AND k = 42
        UNION ALL SELECT 8, id FROM e WHERE kind = 4 UNION ALL SELECT 9, id FROM e WHERE kind = 4
        UNION ALL SELECT 10, id FROM e WHERE kind = 4
        UNION ALL SELECT 14, id FROM e WHERE id % 6 = 1 AND k = 42 UNION ALL SELECT 15, id FROM e WHERE id % 6 = 1 AND k = 42
        UNION ALL SELECT 16, id FROM e WHERE id % 6 = 0 AND k = 42 UNION ALL SELECT 17, id FROM e WHERE id % 6 = 2 AND k = 42
        UNION ALL SELECT 18, id FROM e WHERE id % 6 = 3 AND k = 42 UNION ALL SELECT 19, id FROM e WHERE id % 6 = 4 AND k = 42
        UNION ALL SELECT 20, id FROM e WHERE id % 6 = 5 OR id % 6 IN (1, 4) AND k = 0)""",
    "asset_json_edge": """WITH e AS (SELECT event_id AS id, event_id % 8 AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT id, '{"id":' || id || ',"type":"F","file_name":"f","dimensions":{"width":null,"height":null},"tags":null,"metadata":' || CASE kind
          WHEN 0 THEN '{"k": ' || k || '}' WHEN 1 THEN '{"k": "' || k || '"}' WHEN 2 THEN '{"k": ' || k || '.70}'
          WHEN 3 THEN '{"k": 1, "k": ' || k || '}' WHEN 4 THEN '{"tags": ["a", ' || k || ', null], "o": {"k": ' || k || ', "z": null}}'
          WHEN 5 THEN '{"k": null, "big": 12345678901234567890123456789012345678901}' WHEN 6 THEN '[' || k || ']' ELSE 'null' END || '}' AS document,
          CASE WHEN kind >= 6 THEN 'metadata' END AS field FROM e""",
    "metadata_has_key": "SELECT event_id AS asset_id FROM events WHERE list_contains(json_keys(props), 'k')",
    "metadata_keys": """SELECT key, count(*) AS documents FROM (SELECT unnest(json_keys(props)) AS key FROM events)
        GROUP BY key""",
    # E
    "count_by_type": f'WITH {_ASSETS} SELECT asset_type, count(id) AS "count" FROM assets GROUP BY asset_type',
    "count_map": """SELECT '{' || string_agg('"' || t || '":' || n, ',' ORDER BY t) || '}' AS counts
        FROM (SELECT o_orderstatus AS t, count(*) AS n FROM orders GROUP BY 1)""",
    "count_columns": """SELECT count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
        count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus = 'video') AS video FROM orders""",
    **{
        name: f'WITH {_SNAPSHOTS} SELECT asset_type, count(*) AS "count" FROM new GROUP BY asset_type'
        for name in ("counts_refresh", "counts_incremental", "stream_counts")
    },
    # F
    "text_index": f"WITH {_POSTINGS} SELECT id, weight, term, tf FROM postings",
    "text_index_catalog": f"WITH {_CATALOG_POSTINGS} SELECT id, weight, term, tf FROM postings",
    "text_index_incremental": f"""WITH {_ASSETS}, {_LINKS},
        fa AS (SELECT a.id, CASE WHEN event_type = 'click' THEN 'click' ELSE file_name END AS file_name
          FROM assets a LEFT JOIN events ON event_id = a.id WHERE event_type IS DISTINCT FROM 'error'),
        fl AS (SELECT asset_id, replace(name, 'small', 'tiny') AS name FROM links JOIN fa ON fa.id = asset_id JOIN tags ON tags.id = tag_id
          LEFT JOIN events ON event_id = asset_id WHERE NOT (coalesce(event_type, '') = 'view' AND contains(name, 'low'))),
        words AS (SELECT id, 'A' AS weight, unnest({_split('file_name')}) AS term FROM fa
          UNION ALL SELECT asset_id, 'B', unnest({_split('name')}) FROM fl)
        SELECT id, weight, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY ALL""",
    "text_vocabulary": f"""WITH {_POSTINGS} SELECT term, count(DISTINCT id) AS documents,
        CAST(sum(tf) AS BIGINT) AS occurrences FROM postings GROUP BY term""",
    "text_match": f"""WITH {_POSTINGS} SELECT *, {_BY_SCORE} FROM (SELECT id, round(sum({_PART}), 6) AS score FROM postings
        WHERE term IN ('the', 'en', 'and', 'of') GROUP BY id HAVING count(DISTINCT term) = 4)""",
    "text_index_english": f"WITH {_ENGLISH} SELECT id, weight, term, tf FROM english",
    "text_match_english": f"""WITH {_ENGLISH} SELECT *, {_BY_SCORE} FROM (SELECT id, round(sum({_PART}), 6) AS score FROM english
        WHERE term IN ('en', 'ing') GROUP BY id HAVING count(DISTINCT term) = 2)""",
    "text_search_english": f"""WITH {_ENGLISH.replace(_POSTINGS, _CATALOG_POSTINGS)}, found AS (
          SELECT id, round(sum({_PART}), 6) AS score FROM english WHERE term IN ('small', 'low') GROUP BY id
          HAVING count(DISTINCT term) = 2)
        SELECT id, file_name, asset_type, coalesce(array_to_string(names, ','), '') AS tags, score, {_BY_SCORE}
        FROM found JOIN assets USING (id) LEFT JOIN lists ON asset_id = id""",
    "text_match_bm25f": f"""WITH {_POSTINGS},
        lengths AS (SELECT id, weight, sum(tf) AS length FROM postings GROUP BY ALL),
        averages AS (SELECT weight, avg(length) AS average FROM lengths GROUP BY weight),
        hits AS (SELECT * FROM postings WHERE term IN ('the', 'en', 'and', 'of')),
        holders AS (SELECT term, count(DISTINCT id) AS df FROM hits GROUP BY term),
        parts AS (
          SELECT h.id, h.term, sum((CASE h.weight WHEN 'A' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) * tf
                 / (0.25::DOUBLE + 0.75::DOUBLE * length / average)) AS pseudo
          FROM hits h JOIN lengths l ON l.id = h.id AND l.weight = h.weight JOIN averages a ON a.weight = h.weight
          GROUP BY ALL)
        SELECT *, {_BY_SCORE} FROM (SELECT id, round(sum(ln(1 + ((SELECT count(DISTINCT id) FROM postings) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
               * pseudo / (1.2::DOUBLE + pseudo)), 6) AS score
        FROM parts JOIN holders USING (term) GROUP BY id HAVING count(*) = 4)""",
    "text_match_batch": f"""WITH {_POSTINGS}, asked AS (
          SELECT DISTINCT item_id AS query_id, unnest({_split('text')}) AS term FROM benchmark),
        wanted AS (SELECT * FROM asked WHERE term <> ''),
        sizes AS (SELECT query_id, count(*) AS needed FROM wanted GROUP BY 1),
        found AS (
          SELECT query_id, id, count(DISTINCT term) AS n, round(sum({_PART}), 6) AS score
          FROM wanted JOIN postings USING (term) GROUP BY ALL)
        SELECT query_id, id, score FROM found JOIN sizes USING (query_id) WHERE n = needed""",
    "text_top_batch": f"""WITH {_CATALOG_POSTINGS}, asked AS (SELECT DISTINCT id AS query_id, unnest({_split('name')}) AS term FROM tags),
        wanted AS (SELECT * FROM asked WHERE term <> ''),
        sizes AS (SELECT query_id, count(*) AS needed FROM wanted GROUP BY 1),
        found AS (
          SELECT query_id, id, count(DISTINCT term) AS n, round(sum({_PART}), 6) AS score
          FROM wanted JOIN postings USING (term) GROUP BY ALL),
        placed AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
          FROM found JOIN sizes USING (query_id) WHERE n = needed)
        SELECT * FROM placed WHERE rank <= 5""",
    "text_search": f"""WITH {_CATALOG_POSTINGS}, found AS (
          SELECT id, round(sum({_PART}), 6) AS score FROM postings WHERE term IN ('small', 'low') GROUP BY id
          HAVING count(DISTINCT term) = 2)
        SELECT id, file_name, asset_type, coalesce(array_to_string(names, ','), '') AS tags, score, {_BY_SCORE}
        FROM found JOIN assets USING (id) LEFT JOIN lists ON asset_id = id""",
    "nearby_radius": f"""WITH {_PLACES} SELECT id, file_name, round(d, 1) AS distance, row_number() OVER (ORDER BY round(d, 3), id) AS rank
        FROM (SELECT *, {_haversine(*_CENTRE)} AS d FROM places) WHERE d <= 2000000""",
    "nearby_batch": f"""WITH {_PLACES}, {_CENTRES} SELECT centre_id, id, round(d, 1) AS distance
        FROM (SELECT centre_id, id, {_haversine('clon', 'clat')} AS d FROM places, centres) WHERE d <= 500000""",
    "nearby_batch_wide": f"""WITH {_PLACES}, {_CENTRES} SELECT centre_id, id, round(d, 1) AS distance
        FROM (SELECT centre_id, id, {_haversine('clon', 'clat')} AS d FROM places, centres) WHERE d <= 7000000""",
    "knn_batch_haversine": f"""WITH {_PLACES}, {_CENTRES}
        SELECT centre_id, row_number() OVER (PARTITION BY centre_id ORDER BY round(d, 3), id) AS rank, id, round(d, 1) AS distance
        FROM (SELECT centre_id, id, {_haversine('clon', 'clat')} AS d FROM places, centres) QUALIFY rank <= 5""",
    "knn_planar": f"""WITH {_PLACES} SELECT id, file_name, round({_planar(*_CENTRE)}, 6) AS distance,
        row_number() OVER (ORDER BY {_planar(*_CENTRE)}, id) AS rank FROM places
        ORDER BY {_planar(*_CENTRE)}, id LIMIT 5""",
    "knn_haversine": f"""WITH {_PLACES} SELECT id, file_name, round({_haversine(*_CENTRE)}, 1) AS distance,
        row_number() OVER (ORDER BY {_haversine(*_CENTRE)}, id) AS rank FROM places
        ORDER BY {_haversine(*_CENTRE)}, id LIMIT 10""",
    "knn_batch": f"""WITH {_PLACES}, {_CENTRES}, ranked AS (
          SELECT centre_id, id, d, row_number() OVER (PARTITION BY centre_id ORDER BY d, id) AS rank
          FROM (SELECT centre_id, id, {_planar('clon', 'clat')} AS d FROM places, centres))
        SELECT centre_id, CAST(rank AS INTEGER) AS rank, id, round(d, 6) AS distance FROM ranked WHERE rank <= 5""",
    # G
    "cache_put": f"""WITH {_PUTS} SELECT key, k, {_TIME.format('expires_at')} AS expires_at
        FROM ({_NEWEST.format(where='')})""",
    "cache_get": f"""WITH {_PUTS}, newest AS ({_NEWEST.format(where=f"WHERE write_ts <= TIMESTAMP '{_AS_OF}'")}),
        asked AS (SELECT DISTINCT CAST(CASE WHEN event_type = 'error' THEN user_id + 1 ELSE user_id END AS VARCHAR) AS key
                  FROM events)
        SELECT a.key, CASE WHEN expires_at IS NULL OR expires_at >= TIMESTAMP '{_AS_OF}' THEN k END AS k
        FROM asked a LEFT JOIN newest n ON n.key = a.key""",
    "cache_get_many": f"""WITH {_PUTS}, gets AS (
          SELECT event_id AS get_id, ts + INTERVAL 6 HOUR AS as_of,
                 CAST(CASE WHEN event_type = 'error' THEN user_id + 1 ELSE user_id END AS VARCHAR) AS key FROM events)
        SELECT get_id, g.key, CASE WHEN expires_at IS NULL OR expires_at >= as_of THEN k END AS k
        FROM gets g ASOF LEFT JOIN puts p ON p.key = g.key AND p.write_ts <= g.as_of""",
    "cache_purge": f"""WITH {_PUTS} SELECT key, k, {_TIME.format('expires_at')} AS expires_at
        FROM ({_NEWEST.format(where=f"WHERE write_ts <= TIMESTAMP '{_AS_OF}'")})
        WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{_AS_OF}'""",
    "stream_cache": f"""WITH {_PUTS}, clock AS (
          SELECT date_trunc('milliseconds', max(write_ts)) - INTERVAL 1 HOUR AS now FROM puts)
        SELECT key, k, seq FROM ({_NEWEST.format(where='')}), clock WHERE expires_at IS NULL OR expires_at >= now""",
    # H
    "queue_enqueue": f"""SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY conv_id, turn) AS id,
        'pending' AS status, '{_AS_OF}' AS created_at, conv_id, turn FROM conversations""",
    "queue_claim": f"""WITH {_MESSAGES}, ranked AS (
          SELECT id, k, row_number() OVER (ORDER BY created_at, id) - 1 AS place FROM messages WHERE status = 'pending')
        SELECT id, CAST(place % 4 AS INTEGER) AS worker, CAST((place % 200) // 4 + 1 AS BIGINT) AS turn,
               CAST(place // 200 AS BIGINT) AS batch_id, k
        FROM ranked WHERE place < 400""",
    "queue_status": f"""WITH {_MESSAGES}, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY status ORDER BY created_at, id) AS place FROM messages),
        marked AS (SELECT CASE WHEN place <= 200 THEN 'processing' ELSE status END AS status, created_at FROM ranked)
        SELECT status, count(*) AS messages, {_TIME.format('min(created_at)')} AS oldest FROM marked GROUP BY status""",
    "queue_backlog": f"""WITH {_MESSAGES} SELECT status, count(*) AS messages, {_TIME.format('min(created_at)')} AS oldest
        FROM messages GROUP BY status""",
    "stream_queue": f"""WITH {_MESSAGES}, ranked AS (
          SELECT id, row_number() OVER (ORDER BY created_at, id) - 1 AS place FROM messages WHERE status = 'pending')
        SELECT id, CASE WHEN place < 200 THEN CAST(place % 4 AS INTEGER) END AS worker,
               CASE WHEN place < 200 THEN CAST(place // 4 + 1 AS BIGINT) END AS turn,
               CASE WHEN place < 200 THEN CAST(0 AS BIGINT) END AS batch FROM ranked""",
    # I
    "audit_diff": f"WITH {_CHANGES} SELECT {_IMAGE_COLUMNS.format(at=_AS_OF)} FROM changes",
    "audit_feed": f"""WITH {_CHANGES} SELECT record_id,
        CASE WHEN NOT had THEN 'INSERT' WHEN NOT has THEN 'DELETE' ELSE 'UPDATE' END AS action, 'assets' AS table_name,
        '{_AS_OF}' AS changed_at, old_type, old_size, new_type, new_size FROM pairs""",
    "audit_log": f"WITH {_LOG} SELECT * FROM log",
    "audit_tail": f"""WITH {_LOG} SELECT *, row_number() OVER (ORDER BY changed_at DESC, id DESC) AS rank FROM log
        ORDER BY changed_at DESC, id DESC LIMIT 10""",
    "audit_replay": f"WITH {_SNAPSHOTS} SELECT * FROM old",
    "audit_replay_now": f"WITH {_SNAPSHOTS} SELECT * FROM new",
    "audit_replay_many": """WITH log AS (
          SELECT user_id AS record_id, ts, max_by(event_type <> 'view', event_id) AS there,
                 max_by(CASE WHEN event_type <> 'view' THEN props END, event_id) AS image FROM events GROUP BY user_id, ts),
        asked AS (SELECT event_id, user_id + 1 AS record_id, ts - INTERVAL 36 HOUR AS at FROM events)
        SELECT event_id, a.record_id, CAST(json_extract(image, '$.k') AS BIGINT) AS k, coalesce(there AND image IS NOT NULL, false) AS there
        FROM asked a ASOF LEFT JOIN log l ON l.record_id = a.record_id AND l.ts <= a.at""",
    "stream_audit_rows": """WITH w AS (SELECT user_id AS record_id, event_id AS seq,
          CASE WHEN event_type <> 'view' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_type <> 'view' AS there FROM events),
        c AS (SELECT *, lag(k) OVER o AS old_k, coalesce(lag(there) OVER o, false) AS was FROM w WINDOW o AS (PARTITION BY record_id ORDER BY seq))
        SELECT record_id, CASE WHEN NOT was THEN 'INSERT' WHEN NOT there THEN 'DELETE' ELSE 'UPDATE' END AS action,
          CASE WHEN was THEN old_k END AS old_k, k AS new_k, seq FROM c WHERE was OR there""",
    "stream_audit": f"WITH {_SNAPSHOTS} SELECT * FROM new",
}
