"""The model's tables in SQL, as the adapters of :mod:`parley.sources.tables` define them."""

MSG = """msg AS (
  SELECT conv_id * 1000 + turn AS message_id, conv_id AS conversation_id, role AS sender_id,
         1704067200000 + conv_id * 86400000 + turn * 60000 AS created_at_ms,
         CASE WHEN turn % 5 = 4 THEN 'media' ELSE 'text' END AS kind,
         CASE WHEN turn % 3 = 2 THEN 'remote_archive_only' ELSE 'local_plain_available' END AS body_state, text
  FROM conversations)"""

CONV = """conv AS (
  SELECT conversation_id, conversation_id % 7 = 0 AS pinned, CASE WHEN conversation_id % 3 = 0 THEN 'b2b' ELSE 'b2c' END AS scope,
         't' || (conversation_id % 4) AS tenant_id, conversation_id % 10 AS community_id, conversation_id % 5 AS domain_id,
         max(created_at_ms) AS last_activity_ms, arg_max(message_id, created_at_ms) AS last_message_id
  FROM msg GROUP BY conversation_id)"""

JOURNAL = """journal AS (
  SELECT event_id AS event_seq, user_id AS conversation_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS message_id,
         epoch_us(ts) // 1000 AS created_at_ms,
         CASE WHEN event_type = 'signup' AND CAST(json_extract_string(props, '$.k') AS BIGINT) = 0 THEN 'conversation_deleted'
              WHEN event_type = 'signup' THEN 'conversation_created' WHEN event_type = 'click' THEN 'message_received'
              WHEN event_type = 'view' THEN 'message_edited' WHEN event_type = 'error' THEN 'message_deleted'
              WHEN event_type = 'purchase' THEN 'media_received' END AS event_type
  FROM events)"""

ASSET = """asset AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT),
                   date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS asset_id,
         l_orderkey AS message_id, o_custkey AS conversation_id,
         CASE l_linenumber % 5 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'audio/ogg' WHEN 3 THEN 'application/pdf' ELSE 'image/png' END AS mime_type,
         CASE l_linenumber % 5 WHEN 0 THEN 'video' WHEN 2 THEN 'audio' WHEN 3 THEN 'document' ELSE 'image' END AS kind,
         CAST(l_quantity * 1048576 AS BIGINT) AS bytes_local,
         CASE l_orderkey % 8 WHEN 0 THEN 'download_in_progress' WHEN 1 THEN 'thumbnail_only' ELSE 'original_local' END AS media_state,
         CASE l_returnflag WHEN 'A' THEN 'primary_backend' WHEN 'N' THEN 'cloud' ELSE '' END AS storage_sink,
         date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * 86400000 AS created_at_ms,
         CASE WHEN o_orderstatus = 'F' THEN 'archive_verified' ELSE 'archive_pending' END AS archive_state,
         c_mktsegment = 'BUILDING' AS pinned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

WORDS = "regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+')"

SCRIPTS = [
    "Han", "Hiragana", "Katakana", "Hangul", "Latin", "Cyrillic", "Arabic", "Hebrew", "Greek",
    "Thai", "Devanagari", "Bengali", "Tamil", "Armenian", "Georgian",
]
_OTHER = "[^" + "".join(rf"\p{{{s}}}" for s in SCRIPTS) + "]*"
_RUNS = "|".join(rf"{_OTHER}\p{{{s}}}(?:{_OTHER}\p{{{s}}})*{_OTHER}" for s in SCRIPTS)
_SCRIPT = "CASE " + " ".join(rf"WHEN regexp_matches(run, '\p{{{s}}}') THEN '{s}'" for s in SCRIPTS) + " ELSE 'Unknown' END"


def grams(name: str, source: str) -> str:
    """CTEs ending in ``name`` (message_id, script, token): distinct n-grams of ``source`` (message_id, text)."""
    return f"""{name}_run AS (SELECT message_id, unnest(regexp_extract_all(coalesce(text, ''), '{_RUNS}')) AS run FROM {source}),
{name}_part AS (
  SELECT message_id, {_SCRIPT} AS script,
         unnest(list_filter(string_split_regex(lower(run), '[\\x09-\\x0D\\x20-\\x40\\x5B-\\x60\\x7B-\\x7E]+'), lambda x: x <> '')) AS part
  FROM {name}_run),
{name}_sized AS (SELECT *, CASE WHEN script IN ('Han', 'Hiragana', 'Katakana') THEN 2 ELSE 3 END AS n FROM {name}_part),
{name} AS (
  SELECT DISTINCT message_id, script, substring(part, i, n) AS token
  FROM (SELECT *, unnest(range(1, greatest(length(part) - n + 2, 1))) AS i FROM {name}_sized))"""


def bm25(name: str, source: str, words: list[str], matches: str) -> str:
    """CTEs ending in ``name`` (message_id, bm25) of rows of ``source`` whose word list ``w`` ``matches``."""
    tf = ", ".join(f"len(list_filter(w, lambda x: {_equal(word)})) AS tf{k}" for k, word in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(words)))
    score = " + ".join(f"ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * l / al))" for k in range(len(words)))
    return f"""{name}_w AS (SELECT message_id, {WORDS} AS w FROM {source}),
{name}_tf AS (SELECT message_id, w, len(w) AS l, {tf} FROM {name}_w),
{name}_df AS (SELECT count(*) AS n, avg(l) AS al, {df} FROM {name}_tf),
{name} AS (SELECT message_id, {score} AS bm25 FROM {name}_tf, {name}_df WHERE {matches})"""


def _equal(word: str) -> str:
    return f"starts_with(x, '{word[:-1]}')" if word.endswith("*") else f"x = '{word}'"


def fuzzy(name: str, grams_of: str, asked: str) -> str:
    """CTEs ending in ``name`` (message_id, fuzzy) from the n-gram tables of messages and of the query."""
    return f"""{name}_asked AS (SELECT script, count(*) AS asked FROM {asked} GROUP BY script),
{name}_hit AS (
  SELECT g.message_id, g.script, count(*) AS n FROM {grams_of} g JOIN {asked} q USING (script, token) GROUP BY g.message_id, g.script),
{name} AS (
  SELECT message_id, sum(n) / (SELECT count(*) FROM {asked}) AS fuzzy FROM {name}_hit JOIN {name}_asked USING (script)
  GROUP BY message_id
  HAVING bool_or(n / asked >= CASE WHEN script IN ('Han', 'Hiragana', 'Katakana') THEN 0.5 ELSE 1.0 / 3 END))"""
