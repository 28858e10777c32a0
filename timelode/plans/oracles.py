"""The SQL twins of the registered queries, written for DuckDB over the same test tables."""

from __future__ import annotations

from timelode.plans.adapters import NOW
from timelode.schemas import ERROR_CODES, RUN_STATUSES, UNIT_TYPES, VIDEO_STATUSES, WORK_PHASES


def _pick(values: tuple[str, ...], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[1 + ({index}) % {len(values)}]"


def _moment(seconds: str) -> str:
    return f"make_timestamp(({seconds}) * 1000000)"


#: Java's trim: characters up to U+0020.
def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


#: The cap of 2 000 windows per video is left out: no test video comes near it.
TABLES = {
    "segments": "SELECT conv_id AS video_id, turn AS segment_id, 12.0 * turn AS s, 12.0 * turn + 12 AS e, text, role AS speaker_id FROM conversations",
    "turns": "SELECT conv_id AS video_id, turn AS seq, 12.0 * turn + 3 AS s, 12.0 * turn + 15 AS e, role AS label FROM conversations",
    "speakers": "SELECT DISTINCT conv_id AS video_id, role AS speaker_id, 'SPEAKER_' || role AS label FROM conversations",
    "videos": f"SELECT doc_id AS video_id, lang AS source, doc_id::VARCHAR AS source_video_id, source AS channel_name, substr(text, 1, 40) AS title, {_pick(VIDEO_STATUSES, 'doc_id')} AS status, {_moment('1700000000 + doc_id * 7919 % 1000003')} AS created_at, text FROM documents",
    "doclines": "SELECT doc_id, source, n_chars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents",
    "frames": "SELECT doc_id AS video_id, doc_id * 100000 + i AS frame_id, i AS frame_index, i * 10.0 AS ts FROM doclines",
    "ocr": """SELECT doc_id * 100000 + i AS frame_id, 0 AS line_no, line AS text, (length(line) % 10) / 10.0 AS confidence FROM doclines
      UNION ALL SELECT doc_id * 100000 + i, 1, n_chars::VARCHAR, 0.9 FROM doclines
      UNION ALL SELECT doc_id * 100000 + i, 2, source, 0.9 FROM doclines WHERE doc_id % 3 = 0""",
    "extents": "SELECT video_id, max(moment)::DOUBLE AS extent FROM (SELECT video_id, e AS moment FROM segments UNION ALL SELECT video_id, ts FROM frames) GROUP BY 1 HAVING max(moment) > 0",
    "windows": "SELECT * FROM (SELECT video_id, k, 25.0::DOUBLE * k AS window_start, least(25.0 * k + 30, extent) AS window_end FROM (SELECT video_id, extent, unnest(range(0, ceil(extent / 25)::BIGINT)) AS k FROM extents)) WHERE window_end > window_start AND window_end - window_start >= 1",
    "spoken": f"""SELECT video_id, k, nullif(coalesce(string_agg(t, ' ' ORDER BY s, segment_id) FILTER (NOT regexp_matches(t, '^\\s*$')), ''), '') AS transcript_text,
        list(label ORDER BY s, segment_id) AS labels
      FROM (SELECT w.video_id, w.k, g.s, g.segment_id, {_trim('g.text')} AS t, p.label FROM windows w JOIN segments g ON g.video_id = w.video_id AND g.e > w.window_start AND g.s < w.window_end
        LEFT JOIN speakers p ON p.video_id = g.video_id AND p.speaker_id = g.speaker_id) GROUP BY ALL""",
    "labelled": "SELECT video_id, k, string_agg(label, ',' ORDER BY p) AS speaker_labels FROM (SELECT video_id, k, label, min(p) AS p FROM (SELECT video_id, k, unnest(labels) AS label, generate_subscripts(labels, 1) AS p FROM spoken) GROUP BY ALL) GROUP BY ALL",
    "shown": f"""SELECT video_id, k, line, row_number() OVER (PARTITION BY video_id, k ORDER BY first) AS p FROM (SELECT w.video_id, w.k, o.t AS line, min((f.ts, f.frame_id, o.line_no)) AS first
      FROM windows w JOIN frames f ON f.video_id = w.video_id AND f.ts >= w.window_start AND f.ts < w.window_end
      JOIN (SELECT frame_id, line_no, {_trim('text')} AS t FROM ocr) o ON o.frame_id = f.frame_id WHERE regexp_matches(o.t, '\\p{{L}}') GROUP BY ALL)""",
    "filled": """SELECT w.*, s.transcript_text, l.speaker_labels, row_number() OVER (PARTITION BY w.video_id ORDER BY w.k) - 1 AS segment_index
      FROM windows w LEFT JOIN spoken s USING (video_id, k) LEFT JOIN labelled l USING (video_id, k)
      WHERE s.transcript_text IS NOT NULL OR l.speaker_labels IS NOT NULL OR EXISTS (SELECT 1 FROM shown o WHERE o.video_id = w.video_id AND o.k = w.k)""",
    "chrome": """SELECT video_id, line FROM (SELECT o.video_id, line, count(*) AS seen FROM shown o JOIN filled f ON f.video_id = o.video_id AND f.k = o.k GROUP BY ALL)
      JOIN (SELECT video_id, count(*) AS n FROM filled GROUP BY 1) USING (video_id) WHERE n >= 4 AND seen >= 0.6::DOUBLE * n""",
    "fused": """SELECT f.video_id, segment_index, window_start AS start_seconds, window_end AS end_seconds, any_value(transcript_text) AS transcript_text, string_agg(o.line, chr(10) ORDER BY o.p) AS ocr_text, any_value(speaker_labels) AS speaker_labels
      FROM filled f LEFT JOIN (SELECT * FROM shown ANTI JOIN chrome USING (video_id, line)) o ON o.video_id = f.video_id AND o.k = f.k GROUP BY ALL""",
    "fusedtext": f"""SELECT video_id, segment_index, CASE WHEN t AND o THEN {_trim('transcript_text')} || ' [VISUAL] ' || {_trim('ocr_text')} WHEN t THEN {_trim('transcript_text')} WHEN o THEN '[VISUAL] ' || {_trim('ocr_text')} ELSE '' END AS text
      FROM (SELECT *, coalesce(NOT regexp_matches(transcript_text, '^\\s*$'), false) AS t, coalesce(NOT regexp_matches(ocr_text, '^\\s*$'), false) AS o FROM fused)""",
    "units": f"""SELECT vec_id AS unit_id, label::BIGINT AS video_id, {_pick(UNIT_TYPES, 'label')} AS type, 'body of ' || vec_id AS content, 1 + (label + vec_id % 2) % 3 AS v,
      CASE WHEN vec_id % 4 > 0 THEN (vec_id % 100)::DOUBLE END AS start_seconds, CASE WHEN vec_id % 4 > 0 THEN (vec_id % 100 + 5)::DOUBLE END AS end_seconds, embedding::DOUBLE[] AS x, {_moment('1700000000 + vec_id')} AS created_at FROM embeddings""",
    "asked": "SELECT arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings",
    "ev": f"""SELECT event_id, user_id AS item_id, user_id % 20 AS run_id, CASE event_type WHEN 'signup' THEN 'ITEM_CREATED' WHEN 'view' THEN 'ITEM_PHASE_ENTERED' WHEN 'click' THEN 'ITEM_PHASE_COMPLETED' WHEN 'error' THEN 'ITEM_FAILED' ELSE 'ITEM_COMPLETED' END AS event_type,
      {_pick(WORK_PHASES, "(props->>'k')::INT")} AS phase, CASE WHEN event_type = 'error' THEN {_pick(ERROR_CODES, "(props->>'k')::INT")} END AS error_code, 1 + day(ts) // 10 AS attempt, ts AS occurred_at FROM events""",
    "laneitems": f"""SELECT user_id AS item_id, user_id % 20 AS run_id, {_pick(RUN_STATUSES, 'user_id')} AS status, {_pick(WORK_PHASES, 'user_id')} AS phase,
      CASE WHEN user_id % 5 >= 3 THEN CASE WHEN user_id % 7 = 0 THEN 'CREATED' ELSE {_pick(WORK_PHASES, 'user_id')} END END AS failed_phase, 1 + user_id % 4 AS attempt, TIMESTAMP '{NOW}' - to_hours((user_id % 48)::INT) AS phase_updated_at,
      CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-01-31 06:00:00' END AS lease_expires_at FROM (SELECT DISTINCT user_id FROM events)""",
    "latest": "SELECT e.*, i.latest FROM ev e JOIN (SELECT item_id, greatest(i.attempt, coalesce(max(e.attempt), 1)) AS latest FROM laneitems i LEFT JOIN ev e USING (item_id) GROUP BY item_id, i.attempt) i USING (item_id) WHERE e.attempt = i.latest",
    "marks": "SELECT item_id, phase, min((epoch_us(occurred_at) // 1000)) FILTER (event_type = 'ITEM_PHASE_ENTERED') AS entered, max((epoch_us(occurred_at) // 1000)) FILTER (event_type = 'ITEM_PHASE_COMPLETED') AS completed FROM latest GROUP BY ALL",
    "phases": f"SELECT unnest({list(WORK_PHASES)}) AS phase, unnest(range(0, {len(WORK_PHASES)})) AS phase_index",
    "lastentered": "SELECT item_id, phase_index AS last_entered FROM (SELECT item_id, arg_max(phase, (occurred_at, event_id)) AS phase FROM latest WHERE event_type = 'ITEM_PHASE_ENTERED' GROUP BY 1) JOIN phases USING (phase)",
    "lanes": f"""SELECT item_id, phase_index::INT AS phase_index, phase, state, CASE state WHEN 'done' THEN completed - entered WHEN 'live' THEN (epoch_us(TIMESTAMP '{NOW}') // 1000) - entered WHEN 'failed' THEN updated - entered WHEN 'cancelled' THEN updated - entered END AS millis
      FROM (SELECT *, CASE WHEN entered IS NULL THEN CASE WHEN phase_index > frontier THEN 'pending' ELSE 'skipped' END WHEN completed IS NOT NULL THEN 'done' WHEN live THEN 'live' WHEN status = 'CANCELLED' THEN 'cancelled' ELSE 'failed' END AS state
      FROM (SELECT i.item_id, i.status, p.phase, p.phase_index, (epoch_us(i.phase_updated_at) // 1000) AS updated, m.entered, m.completed, i.status IN ('PENDING', 'IN_PROGRESS') AS live,
        CASE WHEN failed_phase IS NOT NULL THEN coalesce(fp.phase_index, -1) WHEN i.status IN ('PENDING', 'IN_PROGRESS') THEN coalesce(l.last_entered, -1) ELSE 9 END AS frontier
        FROM laneitems i CROSS JOIN phases p LEFT JOIN phases fp ON fp.phase = i.failed_phase LEFT JOIN lastentered l ON l.item_id = i.item_id LEFT JOIN marks m ON m.item_id = i.item_id AND m.phase = p.phase))""",
    "runs": "SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'O' THEN 'IN_PROGRESS' WHEN 'P' THEN 'PENDING' ELSE 'FAILED' END AS status, 'METADATA' AS phase, o_orderdate AS created_at FROM orders",
    "items": f"""SELECT *, CASE WHEN ended AND line <> 1 THEN {_pick(ERROR_CODES, 'video_id')} END AS error_code, CASE WHEN ended THEN 'error ' || supp END AS error, CASE WHEN supp % 2 = 0 THEN TIMESTAMP '1997-01-01' END AS lease_expires_at, CASE WHEN line <> 2 THEN line END AS attempt
      FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item_id, l_orderkey AS run_id, 'https://v/' || l_partkey AS url, l_linenumber AS line, l_suppkey AS supp, l_partkey AS video_id, l_shipdate AS created_at,
        CASE WHEN l_returnflag = 'A' THEN 'COMPLETED' WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_linestatus = 'F' THEN 'CANCELLED' ELSE 'PENDING' END AS status, l_returnflag = 'R' OR (l_returnflag = 'N' AND l_linestatus = 'F') AS ended FROM lineitem)""",
    "ofrun": """SELECT run_id, bool_or(status = 'PENDING') AS live, bool_or(status = 'FAILED') AS failed, bool_and(status = 'CANCELLED') AS cancelled,
      arg_min(struct_pack(c := error_code, e := error), (created_at, item_id)) FILTER (status = 'FAILED') AS f, arg_min(struct_pack(c := error_code, e := error), (created_at, item_id)) FILTER (status = 'CANCELLED') AS x FROM items GROUP BY 1""",
    "derived": """SELECT run_id, CASE WHEN live IS NULL THEN status WHEN live THEN 'IN_PROGRESS' WHEN failed THEN 'FAILED' WHEN cancelled THEN 'CANCELLED' ELSE 'COMPLETED' END AS status, CASE WHEN live IS NULL OR live THEN phase ELSE 'DONE' END AS phase,
      CASE WHEN live IS NULL OR live THEN NULL WHEN failed THEN f.c WHEN cancelled THEN x.c END AS error_code, CASE WHEN live IS NULL OR live THEN NULL WHEN failed THEN f.e WHEN cancelled THEN x.e END AS error, status AS old_status FROM runs LEFT JOIN ofrun USING (run_id)""",
    "partvideos": f"SELECT p_partkey AS video_id, CASE WHEN p_partkey % 6 = 0 THEN 'vimeo' ELSE 'youtube' END AS source, p_brand AS channel_name, p_name AS title, {_pick(VIDEO_STATUSES, 'p_partkey')} AS status, CASE WHEN p_partkey % 10 > 0 THEN {_moment('1700000000 + p_partkey % 5')} END AS created_at FROM part WHERE p_partkey % 2 = 0",
    "channels": f"SELECT s_suppkey AS channel_id, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS display_name, {_moment('1700000000 + s_suppkey % 7')} AS created_at FROM supplier",
    "cat": "SELECT l_suppkey AS channel_id, l_partkey AS id, l_partkey::VARCHAR AS youtube_video_id, CASE WHEN l_partkey % 5 > 0 THEN min(l_shipdate) END AS published_at, 'https://w/' || l_partkey AS watch_url FROM lineitem GROUP BY l_suppkey, l_partkey",
    "ing": "SELECT DISTINCT video_id::VARCHAR AS youtube_video_id FROM partvideos WHERE source = 'youtube'",
    "req": """SELECT page_id % 10 AS req_id, page_id AS pos, CASE WHEN page_id % 5 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END AS url FROM pages
      UNION ALL SELECT page_id % 10, page_id + 1000000000, CASE WHEN page_id % 5 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END FROM pages WHERE page_id % 4 = 0""",
    "replies": "SELECT doc_id % 50 AS video_id, doc_id AS batch, doc_id, text FROM documents",
    "scored": "SELECT 'quality ' || quality AS arm, doc_id % 5 AS rep, doc_id AS unit_id, CASE WHEN doc_id % 3 = 0 THEN 'PROCEDURE' ELSE 'CLAIM' END AS type, lower(substr(text, 1, 20) || ' ' || text) AS blob FROM documents JOIN labels USING (doc_id)",
    "facts": "SELECT 'fact ' || item_id AS label, lower(w[1]) AS a, lower(w[2]) AS b, lower(w[3]) AS c, lower(w[4]) AS d, lower(w[5]) AS e FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)",
    "runblobs": "SELECT arm, rep, count(*) AS n_units, count(*) FILTER (type = 'PROCEDURE') AS n_procedures, string_agg(blob, ' ' ORDER BY unit_id) AS blob FROM scored GROUP BY ALL",
    "runfacts": "SELECT DISTINCT arm, rep, label FROM runblobs JOIN facts ON (contains(blob, a) AND contains(blob, b) AND contains(blob, c)) OR (contains(blob, d) AND contains(blob, e))",
    "scores": """SELECT r.arm, r.rep, n_units, n_procedures, coalesce(f.facts, '') AS facts, coalesce(n_facts, 0) AS n_facts, coalesce(n_noise, 0) AS n_noise FROM runblobs r
      LEFT JOIN (SELECT arm, rep, string_agg(label, ',' ORDER BY label) AS facts, count(*) AS n_facts FROM runfacts GROUP BY ALL) f USING (arm, rep)
      LEFT JOIN (SELECT arm, rep, count(*) AS n_noise FROM scored WHERE contains(blob, 'all rights reserved') OR contains(blob, 'lorem') GROUP BY ALL) n USING (arm, rep)""",
    "arms": "SELECT arm, count(*) AS reps, " + ", ".join(f"{f}({c})::DOUBLE AS {n}_{c[2:]}" if n == "mean" else f"{f}({c}) AS {n}_{c[2:]}" for c in ("n_units", "n_procedures", "n_facts", "n_noise") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + " FROM scores GROUP BY 1",
}

NEEDS = {
    "frames": ["doclines"], "ocr": ["doclines"], "extents": ["segments", "frames"], "windows": ["extents"], "spoken": ["windows", "segments", "speakers"], "labelled": ["spoken"], "shown": ["windows", "frames", "ocr"],
    "filled": ["windows", "spoken", "labelled", "shown"], "chrome": ["shown", "filled"], "fused": ["filled", "shown", "chrome"], "fusedtext": ["fused"], "latest": ["ev", "laneitems"], "marks": ["latest"], "lastentered": ["latest", "phases"],
    "lanes": ["laneitems", "phases", "lastentered", "marks"], "ofrun": ["items"], "derived": ["runs", "ofrun"], "ing": ["partvideos"], "runblobs": ["scored"], "runfacts": ["runblobs", "facts"], "scores": ["runblobs", "runfacts", "scored"], "arms": ["scores"],
}


def sql(query: str, *tables: str, recursive: str = "") -> str:
    """The query behind the CTEs of the tables it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for t in tables:
        add(t)
    parts = [f"{n} AS (\n{TABLES[n]}\n)" for n in order] + ([recursive] if recursive else [])
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + query


#: Windows of at most 900 characters over text(key, t), cut back to a space; the twin of `cut_chunks`.
CUTS = """cuts AS (
  SELECT key, t, 0 AS n, 0 AS pos0, CASE WHEN length(t) <= 900 THEN length(t) ELSE CASE WHEN sp(substr(t, 1, 901)) >= 450 THEN sp(substr(t, 1, 901)) ELSE 900 END END AS fin FROM src WHERE length(t) > 0
  UNION ALL
  SELECT key, t, n + 1, greatest(fin - 150, pos0 + 1), CASE WHEN length(t) <= greatest(fin - 150, pos0 + 1) + 900 THEN length(t)
    ELSE CASE WHEN greatest(fin - 150, pos0 + 1) + sp(substr(t, greatest(fin - 150, pos0 + 1) + 1, 901)) >= greatest(fin - 150, pos0 + 1) + 450 AND sp(substr(t, greatest(fin - 150, pos0 + 1) + 1, 901)) >= 0 THEN greatest(fin - 150, pos0 + 1) + sp(substr(t, greatest(fin - 150, pos0 + 1) + 1, 901)) ELSE greatest(fin - 150, pos0 + 1) + 900 END END
  FROM cuts WHERE fin < length(t)
)""".replace("sp(substr(t, 1, 901))", "(length(substr(t, 1, 901)) - instr(reverse(substr(t, 1, 901)), ' '))").replace("sp(substr(t, greatest(fin - 150, pos0 + 1) + 1, 901))", "(length(substr(t, greatest(fin - 150, pos0 + 1) + 1, 901)) - CASE WHEN instr(reverse(substr(t, greatest(fin - 150, pos0 + 1) + 1, 901)), ' ') = 0 THEN 2000 ELSE instr(reverse(substr(t, greatest(fin - 150, pos0 + 1) + 1, 901)), ' ') END)")
SQUEEZED = "trim(regexp_replace({}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"

NOT_LIVE = "(lease_expires_at IS NULL OR lease_expires_at <= {})"
RETRIED = f"""SELECT * FROM items WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'FAILED') AND status NOT IN ('COMPLETED', 'CANCELLED') AND {NOT_LIVE.format("TIMESTAMP '1996-01-01'")}"""

_HOUR = "date_trunc('hour', occurred_at)"

#: How much of everything a video has.
COUNTS = """SELECT v.video_id, coalesce(a.n, 0) AS n_speakers, coalesce(b.n, 0) AS n_ocr_frames, coalesce(c.n, 0) AS n_fused, coalesce(d.n, 0) AS n_segments, coalesce(e.n, 0) AS n_units FROM videos v
      LEFT JOIN (SELECT video_id, count(*) AS n FROM speakers GROUP BY 1) a ON a.video_id = v.video_id LEFT JOIN (SELECT video_id, count(*) AS n FROM frames GROUP BY 1) b ON b.video_id = v.video_id LEFT JOIN (SELECT video_id, count(*) AS n FROM fused GROUP BY 1) c ON c.video_id = v.video_id
      LEFT JOIN (SELECT video_id, count(*) AS n FROM segments GROUP BY 1) d ON d.video_id = v.video_id LEFT JOIN (SELECT video_id, count(*) AS n FROM units GROUP BY 1) e ON e.video_id = v.video_id"""

ORACLES = {
    "timeline_extent": sql("SELECT * FROM extents", "extents"),
    "sliding_windows": sql("SELECT * FROM windows", "windows"),
    "window_transcript": sql("SELECT s.video_id, s.k, transcript_text, coalesce(speaker_labels, '') AS speaker_labels FROM spoken s LEFT JOIN labelled l USING (video_id, k)", "spoken", "labelled"),
    "window_ocr": sql("SELECT video_id, k, string_agg(line, chr(10) ORDER BY p) AS lines FROM shown GROUP BY ALL", "shown"),
    "chrome_lines": sql("SELECT video_id, line FROM (SELECT video_id, line, count(*) AS seen FROM shown GROUP BY ALL) JOIN (SELECT video_id, count(*) AS n FROM filled GROUP BY 1) USING (video_id) WHERE n >= 4 AND seen >= 0.6::DOUBLE * n", "shown", "filled"),
    "chrome_savings": sql("""SELECT video_id, sum(length(line))::BIGINT AS before, coalesce(sum(length(line)) FILTER (c IS NULL), 0)::BIGINT AS after, CASE WHEN sum(length(line)) > 0 THEN ((sum(length(line)) - coalesce(sum(length(line)) FILTER (c IS NULL), 0)) * 100 // sum(length(line)))::BIGINT ELSE 0 END AS percent
      FROM shown LEFT JOIN (SELECT video_id, line, 1 AS c FROM (SELECT video_id, line, count(*) AS seen FROM shown GROUP BY ALL) JOIN (SELECT video_id, count(*) AS n FROM filled GROUP BY 1) USING (video_id) WHERE n >= 4 AND seen >= 0.6::DOUBLE * n) USING (video_id, line) GROUP BY 1""", "shown", "filled"),
    "fuse_segments": sql("SELECT * FROM fused", "fused"),
    "signal_union": sql("SELECT video_id, count(moment) AS n_signals FROM (SELECT video_id, e AS moment FROM segments UNION ALL SELECT video_id, ts FROM frames UNION ALL SELECT doc_id, NULL FROM documents) GROUP BY 1", "segments", "frames"),
    "build_frames": sql("""SELECT f.video_id, f.frame_index::INT AS frame_index, coalesce(l.pts, 0.0) AS timestamp_seconds, 'f' || lpad(f.frame_index::VARCHAR, 4, '0') AS file_path, CASE WHEN l.pts IS NOT NULL THEN 640 END AS width, CASE WHEN l.pts IS NOT NULL THEN 360 END AS height,
        CASE WHEN least(coalesce(l.pts, 0) % 10, 10 - coalesce(l.pts, 0) % 10) <= 0.5 THEN 'INTERVAL' ELSE 'SCENE_CHANGE' END AS sampling_reason
      FROM frames f LEFT JOIN (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS frame_index, ts::DOUBLE * 1.04::DOUBLE AS pts FROM frames WHERE frame_index % 7 <> 6) l ON l.video_id = f.video_id AND l.frame_index = f.frame_index WHERE f.frame_index < 600""", "frames"),
    "assign_speakers": sql("""SELECT g.video_id, g.segment_id, CASE WHEN max(least(g.e, t.e) - greatest(g.s, t.s)) >= 0.25 THEN arg_max(t.label, (least(g.e, t.e) - greatest(g.s, t.s), -t.seq)) END AS speaker_label
      FROM segments g LEFT JOIN turns t ON t.video_id = g.video_id AND least(g.e, t.e) > greatest(g.s, t.s) GROUP BY ALL""", "segments", "turns"),
    "speaker_labels": sql("SELECT video_id, segment_id, 'SPEAKER_' || speaker_id AS speaker_label FROM segments", "segments"),
    "speakers_from_turns": sql("SELECT video_id, label FROM speakers UNION SELECT video_id, label FROM turns", "speakers", "turns"),
    "timeline_window": sql("SELECT video_id, segment_index, start_seconds, end_seconds FROM fused WHERE end_seconds > 35 AND start_seconds < 55", "fused"),
    "batch_by_budget": sql("SELECT video_id, segment_index, batch FROM walk", "fused", recursive="""sized AS (SELECT video_id, segment_index, 32 + coalesce(length(transcript_text), 0) + coalesce(length(ocr_text), 0) AS c FROM fused),
      walk AS (SELECT video_id, segment_index, c AS used, 0 AS batch FROM sized WHERE segment_index = 0
      UNION ALL SELECT s.video_id, s.segment_index, CASE WHEN w.used + s.c <= 4000 THEN w.used + s.c ELSE s.c END, CASE WHEN w.used + s.c <= 4000 THEN w.batch ELSE w.batch + 1 END FROM walk w JOIN sized s ON s.video_id = w.video_id AND s.segment_index = w.segment_index + 1)"""),
    "render_batch_prompt": sql(f"""SELECT video_id, 0 AS batch, 'Extract knowledge units from the following ' || count(*) || ' segments. The ''index'' field is the value to use in source_segment_indices.' || chr(10) || chr(10) || string_agg('---' || chr(10) || 'index: ' || segment_index || chr(10) || format('time: [{{:.2f}}, {{:.2f}}]', start_seconds, end_seconds) || chr(10)
        || coalesce('transcript: ' || {_trim('transcript_text')} || chr(10), '') || coalesce('on_screen_text: ' || {_trim('ocr_text')} || chr(10), ''), '' ORDER BY segment_index) || '---' || chr(10) AS prompt FROM fused GROUP BY 1""", "fused"),
    "parse_units": sql(f"""SELECT video_id, batch, 0 AS pos, CASE WHEN doc_id % 6 = 1 THEN 'TOPIC' ELSE 'CLAIM' END AS type, 'title ' || doc_id AS title, {_trim('text')} AS content, (doc_id % 10) / 10.0::DOUBLE AS salience, (doc_id % 7) || ',' || (doc_id % 3) AS source_segment_indices
      FROM replies WHERE doc_id % 6 IN (0, 1, 2) AND NOT regexp_matches(text, '^\\s*$')""", "replies"),
    "extraction_verdict": sql("SELECT video_id, count(*) AS n_batches, count(*) FILTER (doc_id % 6 >= 4 OR (doc_id % 6 <> 3 AND regexp_matches(text, '^\\s*$'))) AS n_failed, n_failed > 0 AS fails FROM replies GROUP BY 1", "replies"),
    "filter_units": "SELECT video_id, pos FROM (SELECT doc_id % 50 AS video_id, doc_id AS pos, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS r FROM documents WHERE doc_id % 4 > 0 AND (doc_id % 5 = 0 OR (doc_id % 10) / 10.0 >= 0.2)) WHERE r <= 300",
    "fact_recall": sql("SELECT * FROM scores", "scores"),
    "compare_arms": sql("""SELECT a.*, recall, a.mean_facts - b.mean_facts AS delta, abs(a.mean_facts - b.mean_facts) < 3 AS within_floor FROM arms a
      JOIN (SELECT arm, string_agg(label || ' ' || coalesce(hits, 0) || '/' || reps, ',' ORDER BY label) AS recall FROM arms CROSS JOIN (SELECT DISTINCT label FROM facts) LEFT JOIN (SELECT arm, label, count(*) AS hits FROM runfacts GROUP BY ALL) USING (arm, label) GROUP BY arm) USING (arm)
      LEFT JOIN arms b ON b.arm <> a.arm AND (SELECT count(*) FROM arms) = 2""", "arms"),
    "fact_hits": sql("SELECT arm, label AS fact, count(*) AS hits FROM runfacts GROUP BY ALL", "runfacts"),
    "arm_delta": sql("SELECT a.mean_facts - b.mean_facts AS delta, abs(a.mean_facts - b.mean_facts) < 3 AS within_floor FROM arms a, arms b WHERE a.arm = 'quality 1' AND b.arm = 'quality 0'", "arms"),
    "chunk_text": sql("SELECT key AS doc_id, n AS pos, trim(substr(t, pos0 + 1, fin - pos0)) AS chunk FROM cuts", recursive=f"src AS (SELECT doc_id AS key, {SQUEEZED.format('text')} AS t FROM documents), {CUTS}"),
    "build_chunks": sql("""SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY segment_index, pos) - 1 AS chunk_index, content FROM (
        SELECT video_id, segment_index, 0 AS pos, text AS content FROM fusedtext WHERE text <> '' AND length(text) <= 1050
        UNION ALL SELECT key[1], key[2], n, trim(substr(t, pos0 + 1, fin - pos0)) FROM cuts)""", "fusedtext",
        recursive=f"""src AS (SELECT [video_id, segment_index] AS key, {SQUEEZED.format('text')} AS t FROM fusedtext WHERE length(text) > 1050
          UNION ALL SELECT [doc_id, 0], {SQUEEZED.format('text')} FROM documents WHERE doc_id NOT IN (SELECT video_id FROM fusedtext WHERE text <> '')), {CUTS}"""),
    "format_fused": sql("SELECT * FROM fusedtext", "fusedtext"),
    "search_chunks": sql("""SELECT n.video_id, title, channel_name, '/files/' || v.video_id || '.mp4' AS file_path, chunk_index, 'chunk ' || chunk_index AS snippet, distance FROM (SELECT label::BIGINT AS video_id, vec_id AS chunk_index, round(list_distance(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, asked ORDER BY list_distance(embedding::DOUBLE[], q), 1, 2 LIMIT 20) n LEFT JOIN videos v ON v.video_id = n.video_id""", "asked", "videos"),
    "search_units": sql("""SELECT n.*, title, channel_name FROM (SELECT unit_id, video_id, type, content AS snippet, start_seconds, end_seconds, round(list_distance(x, q), 6) AS distance FROM units, asked WHERE type = 'TOPIC' ORDER BY list_distance(x, q), unit_id LIMIT 50) n LEFT JOIN videos v ON v.video_id = n.video_id""", "units", "asked", "videos"),
    "search_batch": "SELECT query_id, id, round(d, 6) AS distance, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 10",
    "latest_attempt": sql("SELECT event_id, item_id, attempt FROM latest", "latest"),
    "phase_lanes": sql("SELECT * FROM lanes", "lanes"),
    "lane_summary": sql("""SELECT i.item_id, coalesce(total, 0)::BIGINT AS total_millis, CASE WHEN broke IS NOT NULL THEN broke.state || ' in ' || broke.phase WHEN running IS NOT NULL THEN 'running ' || running WHEN dead AND i.status IN ('FAILED', 'CANCELLED') THEN lower(i.status) || ' before any phase ran' WHEN i.status = 'PENDING' THEN 'not started' ELSE 'complete' END AS text, coalesce(p.pending_runs, '') AS pending_runs
      FROM laneitems i JOIN (SELECT item_id, sum(millis) AS total, arg_min(struct_pack(state, phase), phase_index) FILTER (state IN ('failed', 'cancelled')) AS broke, arg_min(phase, phase_index) FILTER (state = 'live') AS running, bool_and(state = 'pending') AS dead FROM lanes GROUP BY 1) s USING (item_id)
      LEFT JOIN (SELECT item_id, string_agg(n::VARCHAR, ',' ORDER BY first) AS pending_runs FROM (SELECT item_id, min(phase_index) AS first, count(*) AS n FROM (SELECT item_id, phase_index, phase_index - row_number() OVER (PARTITION BY item_id ORDER BY phase_index) AS g FROM lanes WHERE state = 'pending') GROUP BY item_id, g) GROUP BY 1) p USING (item_id)""", "lanes"),
    "phase_metrics": sql("SELECT phase, state, count(*) AS n, round(avg(millis), 3) AS avg_millis, max(millis) AS max_millis FROM lanes WHERE millis IS NOT NULL GROUP BY ALL", "lanes"),
    "error_tally": sql("SELECT status, coalesce(error_code, 'NONE') AS error_code, count(*) AS n FROM items WHERE status IN ('FAILED', 'CANCELLED') GROUP BY ALL", "items"),
    "status_tally": sql("SELECT status, count(*) AS n FROM items GROUP BY 1 UNION ALL SELECT 'ALL', count(*) FROM items UNION ALL SELECT 'IN_FLIGHT', count(*) FROM items WHERE status = 'PENDING'", "items"),
    "run_status": sql("SELECT run_id, status, phase, error_code, error FROM derived", "derived"),
    "reconcile_runs": sql("""SELECT run_id, CASE WHEN status = 'IN_PROGRESS' AND NOT leased THEN 'FAILED' ELSE status END AS status, CASE WHEN status = 'IN_PROGRESS' AND NOT leased THEN 'UNEXPECTED' ELSE error_code END AS error_code
      FROM (SELECT *, run_id IN (SELECT run_id FROM items WHERE lease_expires_at > TIMESTAMP '1996-01-01') AS leased FROM derived WHERE old_status = 'IN_PROGRESS')""", "derived"),
    "retry_eligibility": sql("""SELECT run_id, item_id, reason IS NULL AS accepted, reason, coalesce(attempt, 1) + (reason IS NULL)::INT AS attempt, CASE WHEN reason IS NULL THEN error_code END AS previous_error_code
      FROM (SELECT *, CASE WHEN status = 'COMPLETED' THEN 'item is completed' WHEN status = 'CANCELLED' THEN 'item is cancelled' WHEN lease_expires_at > TIMESTAMP '1996-01-01' THEN 'item is leased' END AS reason FROM items WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'FAILED'))""", "items", "runs"),
    "stuck_items": sql(f"SELECT item_id, 'FAILED' AS status, phase AS failed_phase, 'DONE' AS phase, 'UNEXPECTED' AS error_code, TIMESTAMP '{NOW}' AS phase_updated_at FROM laneitems WHERE status IN ('PENDING', 'IN_PROGRESS') AND phase_updated_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND {NOT_LIVE.format(f'''TIMESTAMP '{NOW}' ''')}", "laneitems"),
    "retry_items": sql(f"SELECT item_id, run_id, 'PENDING' AS status, 'CREATED' AS phase, coalesce(attempt, 1) + 1 AS attempt, NULL::VARCHAR AS error_code, NULL::BIGINT AS video_id FROM ({RETRIED})", "items", "runs"),
    "retry_events": sql(f"SELECT item_id, 'ITEM_RETRY_REQUESTED' AS event_type, coalesce(attempt, 1) + 1 AS attempt, 'METADATA' AS phase, error_code, error FROM ({RETRIED})", "items", "runs"),
    "retry_runs": sql(f"SELECT DISTINCT run_id, 'IN_PROGRESS' AS status FROM ({RETRIED})", "items", "runs"),
    "stuck_runs": sql(f"""SELECT run_id, CASE WHEN bool_or(live AND NOT stuck) THEN 'IN_PROGRESS' ELSE 'FAILED' END AS status, CASE WHEN bool_or(live AND NOT stuck) THEN 'METADATA' ELSE 'DONE' END AS phase
      FROM (SELECT *, status IN ('PENDING', 'IN_PROGRESS') AS live, live AND phase_updated_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND {NOT_LIVE.format(f"TIMESTAMP '{NOW}'")} AS stuck FROM laneitems) GROUP BY 1 HAVING bool_or(stuck)""", "laneitems"),
    "events_per_item_phase": sql("SELECT item_id, phase, count(*) AS n FROM ev GROUP BY ALL", "ev"),
    "events_per_day": sql("SELECT occurred_at::DATE AS day, count(*) AS n FROM ev GROUP BY 1", "ev"),
    "filter_events": sql("SELECT event_id, item_id, phase, error_code FROM ev WHERE event_type = 'ITEM_FAILED' AND phase = 'OCR' AND occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-20'", "ev"),
    "filter_events_page": sql("SELECT event_id, item_id, count(*) OVER () AS total FROM ev WHERE event_type = 'ITEM_FAILED' AND phase = 'OCR' AND occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-20' ORDER BY occurred_at DESC, event_id DESC LIMIT 100", "ev"),
    "item_events": sql("SELECT event_id, item_id, event_type, count(*) OVER () AS total FROM ev WHERE item_id = 7 ORDER BY occurred_at, event_id LIMIT 20 OFFSET 20", "ev"),
    "run_events": sql("SELECT event_id, run_id, event_type, count(*) OVER () AS total FROM ev WHERE run_id = 7 ORDER BY occurred_at, event_id LIMIT 100", "ev"),
    "event_tail": sql("SELECT event_id, item_id FROM (SELECT *, row_number() OVER (ORDER BY occurred_at, event_id) - 1 AS r, count(*) OVER () AS n FROM ev WHERE run_id = 7) WHERE r >= greatest(0, (n + 49) // 50 - 4) * 50", "ev"),
    "items_from_events": sql("""SELECT item_id, e.run_id, CASE WHEN retried IS NULL OR v.moment > retried THEN v.video_id END AS video_id, status, CASE WHEN status IN ('COMPLETED', 'FAILED') THEN 'DONE' WHEN status = 'PENDING' THEN 'CREATED' ELSE e.phase END AS phase,
        CASE WHEN status = 'FAILED' THEN e.phase END AS failed_phase, e.attempt::INT AS attempt, CASE WHEN status = 'FAILED' THEN e.error_code END AS error_code, CASE WHEN status = 'FAILED' THEN e.error END AS error, e.occurred_at AS phase_updated_at
      FROM (SELECT *, CASE e.kind WHEN 'ITEM_COMPLETED' THEN 'COMPLETED' WHEN 'ITEM_FAILED' THEN 'FAILED' WHEN 'ITEM_CREATED' THEN 'PENDING' WHEN 'ITEM_RETRY_REQUESTED' THEN 'PENDING' ELSE 'IN_PROGRESS' END AS status FROM (
        SELECT item_id, arg_max(struct_pack(run_id, kind, phase, attempt, occurred_at, error_code, error), moment) AS e, arg_max(struct_pack(video_id, moment), moment) FILTER (kind = 'ITEM_VIDEO_ATTACHED') AS v, max(moment) FILTER (kind = 'ITEM_RETRY_REQUESTED') AS retried
        FROM (SELECT *, (occurred_at, event_id) AS moment, event_id % 1000 AS video_id, 'error ' || event_id % 50 AS error, CASE WHEN event_type = 'ITEM_PHASE_ENTERED' AND event_id % 3 = 0 THEN 'ITEM_VIDEO_ATTACHED' WHEN event_type = 'ITEM_CREATED' AND event_id % 4 = 0 THEN 'ITEM_RETRY_REQUESTED' ELSE event_type END AS kind FROM ev) GROUP BY 1))""", "ev"),
    "intake_urls": sql("SELECT req_id, pos, url, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'url must start with http:// or https://' WHEN row_number() OVER (PARTITION BY req_id, url ORDER BY pos) > 1 THEN 'duplicate url in request' ELSE 'ACCEPTED' END AS verdict FROM req", "req"),
    "transition_events": sql("SELECT item_id, 'ITEM_FAILED' AS event_type, attempt::INT AS attempt, coalesce(failed_phase, phase) AS phase, status FROM laneitems WHERE status = 'FAILED'", "laneitems"),
    "run_previews": sql("""SELECT run_id, count(*) AS n_videos, arg_min(video_id, o) AS video_id, arg_min(title, o) AS title FROM (SELECT i.run_id, i.video_id, v.title, (CASE v.status WHEN 'COMPLETED' THEN 0 WHEN 'PROCESSING' THEN 1 WHEN 'TRANSCRIBING' THEN 2 WHEN 'DOWNLOADED' THEN 3 WHEN 'DOWNLOADING' THEN 4 WHEN 'EXTRACTING' THEN 5 WHEN 'PENDING' THEN 6 ELSE 7 END, v.created_at IS NULL, coalesce(v.created_at, TIMESTAMP '2000-01-01'), i.video_id) AS o
      FROM items i JOIN partvideos v USING (video_id)) GROUP BY 1""", "items", "partvideos"),
    "run_details": sql("""SELECT i.run_id, item_id, url, i.status, 'METADATA' AS phase, coalesce(attempt, 1) AS attempt, channel_name, title, i.created_at FROM items i SEMI JOIN runs r ON r.run_id = i.run_id LEFT JOIN partvideos v USING (video_id)
      UNION ALL SELECT run_id, NULL, 'https://v/' || run_id, status, phase, 1, NULL, NULL, created_at FROM runs ANTI JOIN items USING (run_id)""", "items", "runs", "partvideos"),
    "live_summaries": sql("SELECT a.run_id, pos, status FROM (SELECT o_orderkey * 2 AS run_id, min(o_custkey) AS pos FROM orders GROUP BY 1) a JOIN runs USING (run_id)", "runs"),
    "list_runs": sql("SELECT run_id, status, created_at, count(*) OVER () AS total FROM runs WHERE status = 'PENDING' ORDER BY created_at DESC, run_id DESC LIMIT 30 OFFSET 30", "runs"),
    "live_runs": sql("SELECT run_id, status, created_at FROM runs WHERE status IN ('PENDING', 'IN_PROGRESS')", "runs"),
    "live_elsewhere": sql("SELECT run_id, status FROM runs WHERE status IN ('PENDING', 'IN_PROGRESS') AND run_id NOT IN (SELECT run_id FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 100)", "runs"),
    "not_ingested": sql("SELECT channel_id, youtube_video_id FROM cat ANTI JOIN ing USING (youtube_video_id)", "cat", "ing"),
    "ingested_flag": sql("SELECT channel_id, youtube_video_id, youtube_video_id IN (SELECT youtube_video_id FROM ing) AS ingested FROM cat", "cat", "ing"),
    "list_channel_videos": sql("SELECT youtube_video_id, published_at, false AS ingested, count(*) OVER () AS total FROM cat ANTI JOIN ing USING (youtube_video_id) WHERE channel_id = 3 ORDER BY published_at DESC NULLS LAST, youtube_video_id LIMIT 40", "cat", "ing"),
    "sync_channel_catalog": sql(f"""SELECT coalesce(c.channel_id, n.channel_id) AS channel_id, coalesce(c.youtube_video_id, n.youtube_video_id) AS youtube_video_id, CASE WHEN n.k IS NOT NULL THEN 'new ' || n.youtube_video_id ELSE 'video ' || c.youtube_video_id END AS title, CASE WHEN n.k IS NOT NULL THEN n.p ELSE c.published_at END AS published_at,
        CASE WHEN n.k IS NOT NULL THEN 'https://n/' || n.youtube_video_id ELSE c.watch_url END AS watch_url, CASE WHEN n.k IS NOT NULL THEN '{{"n": 1}}' ELSE '{{}}' END AS metadata, CASE WHEN c.channel_id IS NOT NULL THEN TIMESTAMP '1999-01-01' ELSE TIMESTAMP '{NOW}' END AS first_seen_at, CASE WHEN n.k IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '1999-01-01' END AS last_seen_at
      FROM cat c FULL JOIN (SELECT l_suppkey AS channel_id, (l_partkey + CASE WHEN l_linenumber = 1 THEN 1000000 ELSE 0 END)::VARCHAR AS youtube_video_id, 1 AS k, arg_min(l_shipdate, (l_orderkey, l_linenumber, l_partkey)) AS p FROM lineitem WHERE l_partkey % 11 > 0 GROUP BY ALL) n
      ON n.channel_id = c.channel_id AND n.youtube_video_id = c.youtube_video_id""", "cat"),
    "name_channels": sql("SELECT channel_id, coalesce(display_name, 'found ' || channel_id) AS display_name FROM channels", "channels"),
    "channels_with_counts": sql("SELECT channel_id, display_name, coalesce(n, 0) AS n_videos FROM channels LEFT JOIN (SELECT channel_id, count(*) AS n FROM cat GROUP BY 1) USING (channel_id)", "channels", "cat"),
    "expand_channel_selection": "SELECT p_partkey AS pos, (p_partkey * 3)::VARCHAR AS youtube_video_id, 'https://w/' || (p_partkey * 3) AS watch_url FROM part WHERE p_partkey * 3 IN (SELECT l_partkey FROM lineitem)",
    "unknown_selection": "SELECT DISTINCT (p_partkey * 3)::VARCHAR AS youtube_video_id FROM part WHERE p_partkey * 3 NOT IN (SELECT l_partkey FROM lineitem)",
    "duplicate_videos": sql("""SELECT item_id, source, source_video_id, CASE WHEN e IS NOT NULL OR claim > 1 THEN 'CANCELLED' ELSE 'IN_PROGRESS' END AS status, CASE WHEN e IS NOT NULL OR claim > 1 THEN 'DUPLICATE_VIDEO' END AS error_code, e AS existing_video_id
      FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item_id, 'youtube' AS source, l_partkey::VARCHAR AS source_video_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim, v.video_id AS e FROM lineitem LEFT JOIN partvideos v ON v.video_id = l_partkey AND v.source = 'youtube')""", "partvideos"),
    "list_videos": sql("SELECT video_id, status, channel_name, count(*) OVER () AS total FROM videos WHERE status = 'COMPLETED' AND lower(channel_name) LIKE '%src1_%' ORDER BY created_at DESC, video_id DESC LIMIT 60", "videos"),
    "list_segments": sql("SELECT segment_id, text, count(*) OVER () AS total FROM segments WHERE video_id = 7", "segments"),
    "list_units": sql("SELECT unit_id, start_seconds FROM units WHERE video_id = 3", "units"),
    "speakers_with_counts": sql("SELECT s.video_id, s.label, count(g.segment_id) AS n_segments FROM speakers s LEFT JOIN segments g ON g.video_id = s.video_id AND g.speaker_id = s.speaker_id GROUP BY ALL", "speakers", "segments"),
    "rename_speakers": sql("SELECT video_id, speaker_id, CASE WHEN video_id % 4 = 0 THEN NULL WHEN video_id % 2 = 0 THEN 'Ann' ELSE speaker_id END AS display_name FROM speakers", "speakers"),
    "filter_ocr_lines": sql("SELECT video_id, frame_id, line_no FROM (SELECT video_id, frame_id, line_no, row_number() OVER (PARTITION BY video_id ORDER BY ts, frame_id, line_no) AS r FROM ocr JOIN frames USING (frame_id) WHERE NOT regexp_matches(text, '^\\s*$') AND confidence >= 0.5) WHERE r <= 10000", "ocr", "frames"),
    "ocr_by_frame": sql("SELECT video_id, frame_id, string_agg(text, chr(10) ORDER BY line_no) AS lines FROM frames JOIN ocr USING (frame_id) GROUP BY ALL", "frames", "ocr"),
    "ocr_frame_page": sql("SELECT frame_id, string_agg(text, chr(10) ORDER BY line_no) AS lines, (SELECT count(DISTINCT frame_id) FROM frames SEMI JOIN ocr USING (frame_id) WHERE video_id = 7) AS total FROM ocr WHERE frame_id IN (SELECT frame_id FROM frames WHERE video_id = 7 ORDER BY ts, frame_id LIMIT 3 OFFSET 3) GROUP BY 1", "frames", "ocr"),
    "video_counts": sql(COUNTS, "videos", "speakers", "frames", "fused", "units"),
    "video_detail": sql(f"""SELECT video_id, title, channel_name, true AS has_transcript, length(text)::INT AS n_chars, CASE WHEN NOT regexp_matches(text, '^\\s*$') THEN substr({_trim('text')}, 1, 400) END AS snippet, n_speakers, n_ocr_frames, n_fused, n_segments, n_units
      FROM videos JOIN ({COUNTS}) USING (video_id)""", "videos", "speakers", "frames", "fused", "units"),
    "stale_videos": sql("SELECT video_id, title, channel_name, count(*) AS n_units, min(v)::INT AS oldest, max(v)::INT AS newest, max(u.created_at) AS last_created FROM units u JOIN videos USING (video_id) GROUP BY ALL HAVING min(v) < 3", "units", "videos"),
    "ocr_phase_verdict": sql("""SELECT *, failed + missing = total AS fails FROM (SELECT video_id, count(*) AS total, count(*) FILTER (frame_id % 4 > 0 AND bad) AS failed, count(*) FILTER (frame_id % 4 = 0) AS missing, count(*) FILTER (frame_id % 4 > 0 AND NOT bad AND frame_id % 3 = 1) AS skipped, count(*) FILTER (frame_id % 4 > 0 AND NOT bad AND frame_id % 3 = 2) AS with_text
      FROM (SELECT *, frame_id % 3 = 0 OR frame_id % 200000 < 100000 AS bad FROM frames) GROUP BY 1)""", "frames"),
    "replace_for_videos": sql("SELECT video_id, segment_id, CASE WHEN video_id % 3 = 0 THEN 'new ' || text ELSE text END AS text FROM segments WHERE video_id % 3 = 0 OR video_id % 7 > 0", "segments"),
    "upsert_videos": sql(f"""SELECT CASE WHEN video_id % 2 = 0 THEN video_id ELSE video_id + 5000000 END AS video_id, source, source_video_id, CASE WHEN video_id % 3 = 0 THEN 'new' ELSE title END AS title, CASE WHEN video_id % 3 = 0 THEN 'DOWNLOADED' ELSE status END AS status, CASE WHEN video_id % 2 = 0 THEN created_at ELSE TIMESTAMP '{NOW}' END AS created_at FROM videos WHERE video_id % 2 = 0 OR video_id % 3 = 0""", "videos"),
    "cascade_delete": sql("SELECT item_id, run_id FROM items WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status = 'FAILED')", "items", "runs"),
    "cascade_set_null": sql("SELECT item_id, CASE WHEN video_id NOT IN (SELECT video_id FROM partvideos WHERE source = 'vimeo') THEN video_id END AS video_id FROM items", "items", "partvideos"),
    "parse_transcripts": f"SELECT conv_id AS video_id, turn::INT AS segment_id, (12.5 * turn)::FLOAT AS start_seconds, (12.5 * turn + 12)::FLOAT AS end_seconds, {_trim('text')} AS text FROM conversations WHERE NOT regexp_matches(text, '^\\s*$')",
    "parse_diarization": sql("SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY seq) - 1)::INT AS seq, s::FLOAT AS start_seconds, e::FLOAT AS end_seconds, label FROM turns", "turns"),
    "parse_ocr": sql(f"SELECT frame_id, line_no, {_trim('text')} AS text, confidence::DOUBLE AS confidence, 2 AS n_points, 'en' AS language FROM ocr WHERE NOT regexp_matches(text, '^\\s*$')", "ocr"),
    "parse_video_metadata": """SELECT doc_id::VARCHAR AS url, 'youtube' AS source, CASE WHEN doc_id % 3 > 0 THEN doc_id::VARCHAR ELSE 'https://youtu.be/' || doc_id END AS source_video_id, source AS channel_name, n_chars // 10 AS duration_seconds,
      CASE WHEN doc_id % 4 > 0 THEN strftime(make_date(2024, m, least(d, day(last_day(make_date(2024, m, 1))))), '%Y-%m-%d') || ' 00:00:00' ELSE strftime(make_timestamp((doc_id + 1700000000) * 1000000), '%Y-%m-%d %H:%M:%S') END AS published_at FROM (SELECT *, doc_id % 12 + 1 AS m, doc_id % 31 + 1 AS d FROM documents)""",
    "parse_channel_listing": """SELECT l_suppkey::VARCHAR AS channel_id, id AS youtube_video_id, 'https://www.youtube.com/watch?v=' || id AS watch_url, 't' || l_partkey AS title, count(*) AS n, strftime(min(l_shipdate), '%Y-%m-%d') AS published
      FROM (SELECT *, CASE WHEN l_partkey % 5 > 0 THEN l_partkey::VARCHAR WHEN l_partkey % 10 > 0 THEN 'u' || l_partkey END AS id FROM lineitem) WHERE id IS NOT NULL GROUP BY l_suppkey, id, l_partkey""",
    "parse_frame_log": sql("SELECT video_id, frame_index::INT AS n, ts::DOUBLE AS pts_time, 640 AS width, 360 AS height FROM frames", "frames"),
    "parse_url_paste": "SELECT DISTINCT page_id % 10 AS req_id, url FROM pages WHERE page_id % 5 > 0",
    "scalar_phases": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'FRAME_SAMPLE,OCR' WHEN 2 THEN '' END AS phases, CASE doc_id % 3 WHEN 0 THEN 'FRAME_SAMPLE,OCR' END AS stored FROM documents",
    "scalar_text": f"""SELECT doc_id, CASE WHEN f = '' THEN 'video' ELSE f END AS filename, substr(text, 1, 220) AS snippet, regexp_matches(text, '\\p{{L}}') AS meaning, regexp_matches(text, '^\\s*$') AS blank, (32 + length(text) + length(source))::INT AS chars, CASE WHEN NOT regexp_matches(text, '^\\s*$') THEN substr({_trim('text')}, 1, 50) END AS start, substr(text, 1, 30) AS cut
      FROM (SELECT *, regexp_replace(substr(trim(regexp_replace(regexp_replace(regexp_replace(text, '[<>:"/\\\\|?*]', '_', 'g'), '[\\x00-\\x1f\\x7f]', '', 'g'), '\\s+', ' ', 'g')), 1, 200), '[.\\s_]+$', '') AS f FROM documents)""",
    "scalar_urls": sql("SELECT req_id, pos, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'url must start with http:// or https://' END AS problem, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_replace(url, '/+$', '') END AS channel_url FROM req", "req"),
    "storage_path": sql("""SELECT video_id, f || '/' || name || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.mkv' AS path FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY video_id) AS n FROM (SELECT video_id, '/lib/' || channel_name || '/' || name AS f, name
      FROM (SELECT video_id, channel_name, strftime(created_at, '%Y%m%d') || '.' || CASE WHEN c = '' THEN 'video' ELSE c END AS name FROM (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(title, '[<>:"/\\\\|?*]', '_', 'g'), '[\\x00-\\x1f\\x7f]+', '', 'g')), '[.\\s_]+$', '') AS c FROM videos))))""", "videos"),
    "clean_units": f"""SELECT doc_id % 50 AS video_id, doc_id AS pos, 't' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN rest = '' THEN body ELSE upper(substr(rest, 1, 1)) || substr(rest, 2) END ELSE kept END AS content,
        '{{' || CASE WHEN doc_id % 5 > 0 THEN '"salience":' || (doc_id % 10) / 10.0::DOUBLE || ',' ELSE '' END || '"source_segment_indices":[' || doc_id % 7 || '],"prompt_version":3,"chat_model":"model"}}' AS metadata
      FROM (SELECT doc_id, 'The video explains how to ' || text AS body, text AS rest, CASE WHEN doc_id % 3 > 0 THEN {_strip('text')} END AS kept FROM documents)""",
    "classify_frame": sql("SELECT frame_id, CASE WHEN least((ts::DOUBLE * 1.03::DOUBLE) % 10, 10 - (ts::DOUBLE * 1.03::DOUBLE) % 10) <= 0.5 THEN 'INTERVAL' ELSE 'SCENE_CHANGE' END AS reason FROM frames", "frames"),
    "stream_events": sql("SELECT event_id, item_id, event_type FROM ev", "ev"),
    "stream_event_counts": sql(f"SELECT * FROM (SELECT event_type, {_HOUR} AS \"start\", {_HOUR} + INTERVAL 1 HOUR AS \"end\", count(*) AS n FROM ev GROUP BY ALL) WHERE \"end\" <= (SELECT max(occurred_at) - INTERVAL 1 HOUR FROM ev)", "ev"),
    "stream_sliding_counts": sql(f"SELECT * FROM (SELECT event_type, {_HOUR} - to_hours(k) AS \"start\", {_HOUR} + to_hours(2 - k) AS \"end\", count(*) AS n FROM ev, (SELECT unnest([0, 1]) AS k) GROUP BY ALL) WHERE \"end\" <= (SELECT max(occurred_at) - INTERVAL 1 HOUR FROM ev)", "ev"),
    "stream_sessions": sql("""SELECT * FROM (SELECT item_id, min(occurred_at) AS "start", max(occurred_at) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY item_id ORDER BY occurred_at, event_id) AS g FROM (SELECT *, CASE WHEN occurred_at - lag(occurred_at) OVER (PARTITION BY item_id ORDER BY occurred_at, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM ev)) GROUP BY item_id, g)
      WHERE "end" <= (SELECT max(occurred_at) - INTERVAL 1 HOUR FROM ev)""", "ev"),
    "stream_phase_durations": sql("""SELECT e.item_id, e.attempt::INT AS attempt, e.p AS phase, epoch_us(c.occurred_at) // 1000 - epoch_us(e.occurred_at) // 1000 AS millis FROM (SELECT ev.*, ((props->>'k')::INT % 10)::VARCHAR AS p FROM ev JOIN events x USING (event_id) WHERE ev.event_type = 'ITEM_PHASE_ENTERED') e JOIN (SELECT ev.*, ((props->>'k')::INT % 10)::VARCHAR AS p FROM ev JOIN events x USING (event_id) WHERE ev.event_type = 'ITEM_PHASE_COMPLETED') c
      ON e.item_id = c.item_id AND e.attempt = c.attempt AND e.p = c.p AND c.occurred_at >= e.occurred_at AND c.occurred_at <= e.occurred_at + INTERVAL 6 HOUR""", "ev"),
    "stream_stuck_items": sql("""SELECT item_id, e.event_type AS last_event, date_trunc('millisecond', e.occurred_at) AS last_at FROM (SELECT item_id, arg_max(struct_pack(event_type, occurred_at), (occurred_at, event_id)) AS e FROM ev GROUP BY 1)
      WHERE e.event_type NOT IN ('ITEM_COMPLETED', 'ITEM_FAILED') AND e.occurred_at + INTERVAL 36 HOUR < (SELECT max(occurred_at) - INTERVAL 10 MINUTE FROM ev)""", "ev"),
    "stream_channel_sync": sql("""SELECT coalesce(c.channel_id, n.channel_id) AS channel_id, coalesce(c.youtube_video_id, n.id) AS youtube_video_id, CASE WHEN n.id IS NOT NULL THEN 'new' ELSE 'video ' || c.youtube_video_id END AS title, CASE WHEN n.id IS NOT NULL THEN n.p ELSE c.published_at END AS published_at
      FROM cat c FULL JOIN (SELECT l_suppkey AS channel_id, l_partkey::VARCHAR AS id, arg_min(l_shipdate, (l_orderkey, l_linenumber, l_partkey)) AS p FROM lineitem GROUP BY ALL) n ON n.channel_id = c.channel_id AND n.id = c.youtube_video_id""", "cat"),
    "write_transcript_artifacts": "SELECT doc_id AS video_id, lang AS language, text, text || chr(10) AS plain FROM documents",
    "append_events": sql("SELECT item_id, 'ITEM_PHASE_ENTERED' AS event_type, attempt::INT AS attempt, phase FROM laneitems", "laneitems"),
    "write_replaced": sql("SELECT video_id, segment_id, CASE WHEN video_id % 10 = 0 THEN 'again' ELSE text END AS text FROM segments WHERE video_id % 5 > 0 OR video_id % 10 = 0", "segments"),
    "read_url_list": "SELECT url FROM pages WHERE page_id % 5 > 0 AND page_id % 7 > 0",
    "parse_scalars_json": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'vimeo' ELSE 'unknown' END AS source, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR WHEN doc_id % 3 = 0 THEN 'https://vimeo.com/1' ELSE 'https://x.org/1' END AS video, source AS channel, '20240229' AS day FROM documents",
    "ingest_job": sql("""SELECT 'youtube:' || page_id AS video_id, 'DOWNLOADED' AS status, 'a title' AS title FROM pages WHERE page_id % 5 > 0 AND page_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)"""),
    "knowledge_job": sql("SELECT video_id, count(*) AS n_units FROM fused GROUP BY 1", "fused"),
    "ocr_job": sql("SELECT video_id, frame_id, line_no FROM ocr JOIN frames USING (frame_id) WHERE NOT regexp_matches(text, '^\\s*$') AND confidence >= 0.5 AND video_id % 7 > 0", "ocr", "frames"),
}

ORACLES["chunk_text_udtf"] = ORACLES["chunk_text"]
ORACLES["context_job"] = f"SELECT video_id, count(*) AS n_chunks, 64 AS dims FROM ({ORACLES['build_chunks']}) GROUP BY 1"
ORACLES["fuse_job"] = sql(
    """SELECT f.video_id, f.segment_index, f.transcript_text, g.labels AS speaker_labels FROM fused f LEFT JOIN (SELECT video_id, k, string_agg(label, ',' ORDER BY p) AS labels FROM (SELECT w.video_id, w.k, a.label, min((a.s, a.segment_id)) AS p FROM windows w JOIN (
      SELECT g.video_id, g.segment_id, g.s, g.e, CASE WHEN max(least(g.e, t.e) - greatest(g.s, t.s)) >= 0.25 THEN arg_max(t.label, (least(g.e, t.e) - greatest(g.s, t.s), -t.seq)) END AS label FROM segments g LEFT JOIN turns t ON t.video_id = g.video_id AND least(g.e, t.e) > greatest(g.s, t.s) GROUP BY ALL) a
      ON a.video_id = w.video_id AND a.e > w.window_start AND a.s < w.window_end WHERE a.label IS NOT NULL GROUP BY ALL) GROUP BY ALL) g ON g.video_id = f.video_id AND g.k = f.start_seconds / 25""",
    "fused", "windows", "segments", "turns",
)
ORACLES["stream_run_status"] = sql(
    """SELECT run_id, CASE WHEN live THEN 'IN_PROGRESS' WHEN failed THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN live THEN 'CREATED' ELSE 'DONE' END AS phase
      FROM (SELECT run_id, bool_or(kind NOT IN ('ITEM_COMPLETED', 'ITEM_FAILED')) AS live, bool_or(kind = 'ITEM_FAILED') AS failed FROM (SELECT item_id, arg_max(run_id, (occurred_at, event_id)) AS run_id, arg_max(event_type, (occurred_at, event_id)) AS kind FROM ev GROUP BY 1) GROUP BY 1)""",
    "ev",
)
ORACLES["embed_texts"] = "SELECT doc_id, 64 AS dims, len(regexp_extract_all(coalesce(text, ''), '\\S+')) % 2 = 1 AS odd FROM documents"
ORACLES["deep_page"] = """SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER () AS total FROM lineitem
  ORDER BY l_shipdate DESC NULLS LAST, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST, l_partkey NULLS FIRST, l_suppkey NULLS FIRST LIMIT 100 OFFSET 3000"""
ORACLES["channel_job"] = sql(
    """SELECT channel_id, youtube_video_id FROM (SELECT channel_id::VARCHAR AS channel_id, youtube_video_id FROM cat
      UNION SELECT l_suppkey::VARCHAR, CASE WHEN l_partkey % 5 > 0 THEN l_partkey::VARCHAR ELSE 'u' || l_partkey END FROM lineitem WHERE l_partkey % 10 > 0) ANTI JOIN ing USING (youtube_video_id)""",
    "cat", "ing",
)
