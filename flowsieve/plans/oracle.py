"""SQL twins of the catalogue's queries, for a check in another engine."""

from __future__ import annotations

from ..operators.dedupe import FilterSize
from . import catalog as c, search

SCALED = c.SCALED

# The flow table; every query starts from it.
FLOWS = """
events_k AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
),
flows AS (
  SELECT event_id AS seq, ts, CAST(user_id AS VARCHAR) AS tenant, '' AS log_type,
         CAST(user_id AS VARCHAR) AS source, event_type AS destination, CAST(k % 10 AS VARCHAR) AS fwd_bytes,
         k AS dst_port, CAST(floor(value * 100) AS BIGINT) AS bwd_packets,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, value, k,
         sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, CAST(k % 10 AS VARCHAR))) AS fp
  FROM events_k
)"""
SIGNATURE = "CASE WHEN dst_port IN (21, 22, 23, 3389, 4444) OR bwd_packets > 10000 THEN 1 ELSE 0 END"


def slot(key: str, workers: int) -> str:
    """md5 modulo a power of two up to 65536: the last four digits decide."""
    return f"CAST(CAST('0x' || right(md5({key}), 4) AS BIGINT) % {workers} AS INTEGER)"


def number(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15) AS BIGINT)"


def rounded(part: str, whole: str) -> str:
    """Integer division to the nearest, ties to even."""
    part, whole = f"CAST({part} AS BIGINT)", f"CAST({whole} AS BIGINT)"
    q, twice = f"({part} // {whole})", f"(2 * ({part} % {whole}))"
    return f"({q} + CASE WHEN {twice} > {whole} OR ({twice} = {whole} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"


def pct(part: str, whole: str) -> str:
    return f"{rounded(f'{part} * 10000', f'greatest({whole}, 1)')} / CAST(100 AS DOUBLE)"


def positions(fp: str, size: FilterSize) -> str:
    slices = [f"CAST('0x' || substr({fp}, {8 * j + 1}, 8) AS BIGINT) % {size.bits}" for j in range(size.hashes)]
    return "[" + ", ".join(slices) + "]"


def stats(flagged: str, by: str = "", false_hits: str = "0", extra: str = "") -> str:
    lead = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    dup = "CAST(coalesce(sum(CASE WHEN is_dup THEN 1 ELSE 0 END), 0) AS BIGINT)"
    return f"""SELECT {lead}{extra}total_records, duplicates, CAST(false_positives AS BIGINT) AS false_positives,
      evaluations, {pct('duplicates', 'total_records')} AS dedupe_rate_pct
    FROM (SELECT {lead}count(*) AS total_records, {dup} AS duplicates,
            coalesce(sum({false_hits}), 0) AS false_positives, count(*) - {dup} AS evaluations
          FROM {flagged}{tail})"""


FALSE_HIT = "CASE WHEN outcome = 'filter_false_positive' THEN 1 ELSE 0 END"


def first_seen(by: str, source: str = "flows") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY seq) > 1 AS is_dup FROM {source}"


def ordered(by: str, marks: str = "[fp]", source: str = "flows") -> str:
    """Rows with their place `p` in their scope; `marks` are what a filter keeps."""
    return f"""pos AS (SELECT *, {marks} AS marks, {by} AS scope,
      row_number() OVER (PARTITION BY {by} ORDER BY seq) AS p FROM {source})"""


def fifo(window: int, by: str = "tenant", source: str = "flows") -> str:
    """Step through all scopes at once, the window held as a list."""
    return f"""{ordered(by, source=source)},
run AS (
  SELECT p, scope, seq, false AS is_dup, [fp] AS queue FROM pos WHERE p = 1
  UNION ALL
  SELECT n.p, n.scope, n.seq, list_contains(r.queue, n.fp),
    CASE WHEN list_contains(r.queue, n.fp) THEN r.queue
         WHEN len(r.queue) >= {window} THEN list_append(r.queue[2:], n.fp)
         ELSE list_append(r.queue, n.fp) END
  FROM run r JOIN pos n ON n.scope = r.scope AND n.p = r.p + 1
),
flagged AS (SELECT f.*, run.is_dup FROM {source} f JOIN run USING (seq))"""


def screened(
    window: int,
    generation: int,
    marks: str = "[fp]",
    by: str = "tenant",
    exact: bool = True,
    on_arrival: bool = False,
    source: str = "flows",
) -> str:
    """Filter generation, cache and queue held as lists per scope."""
    full = f"len(r.queue) >= {window}"
    room_queue = f"CASE WHEN {full} THEN r.queue[2:] ELSE r.queue END"
    room_cache = f"CASE WHEN {full} THEN [x FOR x IN r.cache IF x <> r.queue[1]] ELSE r.cache END"
    turned = f"r.inserted >= {generation}"
    gen0 = f"CASE WHEN {turned} THEN r.gen[1:0] ELSE r.gen END"
    ins0 = f"CASE WHEN {turned} THEN 0 ELSE r.inserted END"
    if on_arrival:
        seen = f"SELECT n.*, {room_queue} AS queue0, {room_cache} AS cache0, {gen0} AS gen0, {ins0} AS ins0"
        after = "queue0, cache0, gen0, ins0"
        keep_gen, keep_ins = "CASE WHEN hit THEN gen0 ELSE gen0 || marks END", "CASE WHEN hit THEN ins0 ELSE ins0 + 1 END"
        lookup_gen, lookup_cache = "gen0", "cache0"
        dup_state = ("queue0", "cache0", "gen0", "ins0")
    else:
        seen = f"""SELECT n.*, r.queue AS queue1, r.cache AS cache1, r.gen AS gen1, r.inserted AS ins1,
          {room_queue} AS queue0, {room_cache} AS cache0, {gen0} AS gen0, {ins0} AS ins0"""
        after = "queue0, cache0, gen0, ins0, queue1, cache1, gen1, ins1"
        keep_gen, keep_ins = "gen0 || marks", "ins0 + 1"
        lookup_gen, lookup_cache = "gen1", "cache1"
        dup_state = ("queue1", "cache1", "gen1", "ins1")
    dup = f"hit AND list_contains({lookup_cache}, fp)" if exact else "hit"
    return f"""{ordered(by, marks, source)},
run AS (
  SELECT p, scope, seq, 'new' AS outcome, [fp] AS queue, [fp] AS cache, marks AS gen, 1 AS inserted
  FROM pos WHERE p = 1
  UNION ALL
  SELECT p, scope, seq,
    CASE WHEN dup THEN 'duplicate' WHEN hit THEN 'filter_false_positive' ELSE 'new' END,
    CASE WHEN dup THEN {dup_state[0]} ELSE list_append(queue0, fp) END,
    CASE WHEN dup THEN {dup_state[1]} WHEN list_contains(cache0, fp) THEN cache0 ELSE list_append(cache0, fp) END,
    CASE WHEN dup THEN {dup_state[2]} ELSE {keep_gen} END,
    CASE WHEN dup THEN {dup_state[3]} ELSE {keep_ins} END
  FROM (
    SELECT *, {dup} AS dup FROM (
      SELECT *, list_has_all({lookup_gen}, marks) AS hit FROM (
        {seen} FROM run r JOIN pos n ON n.scope = r.scope AND n.p = r.p + 1)))
),
flagged AS (
  SELECT f.*, run.outcome, run.outcome = 'duplicate' AS is_dup FROM {source} f JOIN run USING (seq))"""


def filter_hits(by: str, size: FilterSize, source: str = "flows") -> str:
    """`firsts` with filter_hit: were all its bits set by earlier arrivals?"""
    lead = f"{by}, " if by else ""
    return f"""bits AS (
  SELECT {lead}seq, unnest({positions('fp', size)}) AS bit FROM {source}),
set_at AS (SELECT {lead}bit, min(seq) AS since FROM bits GROUP BY {lead}bit),
hits AS (
  SELECT seq, max(since) < seq AS filter_hit FROM bits JOIN set_at USING ({lead}bit) GROUP BY seq),
screened AS (
  SELECT f.*, filter_hit,
    row_number() OVER (PARTITION BY {lead}fp ORDER BY seq) > 1 AS repeated
  FROM {source} f JOIN hits USING (seq))"""


def lookback(gap: str, limit: int) -> str:
    return f"coalesce({gap} <= {limit}, false)"


def lagged(column: str) -> str:
    return f"lag({column}) OVER (PARTITION BY tenant, log_type, fp ORDER BY seq)"


# Time order, split, scaled features, history means and verdicts.
DETECTION = f"""
ordered AS (
  SELECT *, row_number() OVER (ORDER BY ts, seq) - 1 AS idx, count(*) OVER () AS n FROM flows),
marked AS (
  SELECT *, CASE WHEN idx < n * 7 // 10 THEN 'train' WHEN idx < n * 8 // 10 THEN 'validation' ELSE 'test' END AS split
  FROM ordered),
fitted AS (
  SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM marked WHERE split = 'train'),
scaled AS (
  SELECT marked.*, (value - mv) / CASE WHEN sv = 0 THEN 1 ELSE sv END AS z_value,
         (k - mk) / CASE WHEN sk = 0 THEN 1 ELSE sk END AS z_k FROM marked, fitted),
history AS (
  SELECT *, avg(z_value) OVER w AS p_z_value, avg(z_k) OVER w AS p_z_k, count(*) OVER w AS length
  FROM scaled WINDOW w AS (PARTITION BY split ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
residuals AS (
  SELECT *, sqrt((z_value - p_z_value) * (z_value - p_z_value) + (z_k - p_z_k) * (z_k - p_z_k)) AS residual,
         {SIGNATURE} AS signature
  FROM history WHERE length = 10),
threshold AS (
  SELECT avg(residual) + 3 * stddev_pop(residual) AS tau, count(*) AS benign_rows
  FROM residuals WHERE split = 'validation' AND label = 0),
verdicts AS (
  SELECT seq, label, signature, CASE WHEN residual > tau THEN 1 ELSE 0 END AS anomaly,
         CASE WHEN signature = 1 THEN 1 WHEN residual > tau THEN 1 ELSE 0 END AS hybrid
  FROM residuals, threshold WHERE split = 'test')"""


def autoregression(features: tuple[str, ...] = ("z_value", "z_k"), lags: int = 10) -> str:
    """p_<feature> by least squares on the feature's lags: normal equations, solved by elimination row by row."""
    known = {f: "[1.0, " + ", ".join(f"lag({f}, {k}) OVER w" for k in range(1, lags + 1)) + "]" for f in features}
    n = lags + 1

    def equations(f: str) -> str:
        sides = [f"x_{f}[{j}]" for j in range(1, n + 1)] + [f]
        rows = ("[" + ", ".join(f"sum(x_{f}[{i}] * {side})" for side in sides) + "]" for i in range(1, n + 1))
        return "[" + ", ".join(rows) + "]"

    ctes = [
        f"""lagged AS (SELECT *, {", ".join(f"{x} AS x_{f}" for f, x in known.items())}, count(*) OVER h AS length FROM scaled
  WINDOW w AS (PARTITION BY split ORDER BY idx),
         h AS (PARTITION BY split ORDER BY idx ROWS BETWEEN {lags} PRECEDING AND 1 PRECEDING))"""
    ]
    for f in features:
        ctes.append(f"""solve_{f} AS (
  SELECT 1 AS k, {equations(f)} AS m FROM lagged WHERE split = 'train' AND label = 0 AND length = {lags}
  UNION ALL
  SELECT k + 1, list_transform(range(1, {n + 1}), lambda i: CASE WHEN i = k
      THEN list_transform(m[k], lambda v: v / m[k][k])
      ELSE list_transform(range(1, {n + 2}), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END)
  FROM solve_{f} WHERE k <= {n}),
weights_{f} AS (SELECT list_transform(m, lambda r: r[{n + 1}]) AS b_{f} FROM solve_{f} WHERE k = {n + 1})""")
    forecasts = ", ".join(
        " + ".join(f"b_{f}[{j}] * x_{f}[{j}]" for j in range(1, n + 1)) + f" AS p_{f}" for f in features
    )
    sources = ", ".join(f"weights_{f}" for f in features)
    ctes.append(f"forecasts AS (SELECT lagged.*, {forecasts} FROM lagged, {sources} WHERE length = {lags})")
    return ", ".join(ctes)


def confusion(truth: str, prediction: str) -> str:
    def n(t, p):
        return f"CAST(sum(CASE WHEN {truth} = {t} AND {prediction} = {p} THEN 1 ELSE 0 END) AS BIGINT)"

    return f"{n(1, 1)} AS tp, {n(0, 1)} AS fp, {n(1, 0)} AS fn, {n(0, 0)} AS tn"


def report(by: str = "") -> str:
    def share(part, whole):
        nearest = rounded(f"({part}) * 10000", f"greatest({whole}, 1)")
        return f"CASE WHEN {whole} = 0 THEN CAST(0 AS DOUBLE) ELSE {nearest} / CAST(10000 AS DOUBLE) END"

    return f"""{by}{share('tp + tn', '(tp + fp + fn + tn)')} AS accuracy, {share('tp', '(tp + fp)')} AS precision,
      {share('tp', '(tp + fn)')} AS recall, {share('2 * tp', '(2 * tp + fp + fn)')} AS f1_score,
      {share('fp', '(fp + tn)')} AS far"""


def pressured(rate: float, name: str, seed: int = 42, source: str = "flows") -> str:
    """`name`: the view with int(rate * n) drawn copies, in hashed order."""
    return f"""{name}_base AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM {source}),
{name}_draws AS (
  SELECT n + d AS row, {number(f"'draw{seed}'", 'd')} % n AS i
  FROM (SELECT count(*) AS n FROM {source}), unnest(range(CAST(floor(n * {rate}) AS BIGINT))) AS t(d)),
{name}_rows AS (
  SELECT i AS row, seq AS origin, tenant, fp FROM {name}_base
  UNION ALL
  SELECT row, b.seq, b.tenant, b.fp FROM {name}_draws JOIN {name}_base b USING (i)),
{name} AS (
  SELECT row_number() OVER (ORDER BY {number(f"'order{seed}'", 'row')}, row) - 1 AS seq, origin, tenant, fp
  FROM {name}_rows)"""


FILTERS = list(dict.fromkeys((e, n) for e, n, _ in search.SEARCH_SETTINGS))


def loaded(rates, source: str = "flows") -> str:
    """`loaded`: the view at several duplicate rates, each a set of scopes of its own."""
    parts = [pressured(rate, f"p{i}", source=source) for i, rate in enumerate(rates)]
    rows = " UNION ALL ".join(
        f"""SELECT CAST({rate} AS DOUBLE) AS duplicate_rate, seq + {i} * 100000000000 AS seq, '{i}:' || tenant AS rated, tenant, fp
        FROM p{i}""" for i, rate in enumerate(rates)
    )
    return f"{', '.join(parts)}, loaded AS ({rows})"


def filter_counts(window: int, rates, before: str, source: str) -> str:
    """Accepted rows and false hits per rate and filter of the search."""
    return " UNION ALL ".join(
        f"""SELECT * FROM (WITH RECURSIVE {before}, {loaded(rates, source)},
        {screened(window, window, positions('fp', FilterSize.for_rate(n, e)), by='rated', source='loaded')}
        SELECT {i} AS f, duplicate_rate, CAST(sum(CASE WHEN is_dup THEN 0 ELSE 1 END) AS BIGINT) AS evaluations,
          CAST(sum({FALSE_HIT}) AS BIGINT) AS false_positives FROM flagged GROUP BY duplicate_rate)"""
        for i, (e, n) in enumerate(FILTERS)
    )


def trials(window: int, before: str = FLOWS, source: str = "flows") -> str:
    """CTEs up to `trials`: the bounded search, in its order."""
    rates = sorted(search.DUPLICATE_RATES)
    counts = sorted({w for _, _, w in search.SEARCH_SETTINGS})
    load = " UNION ALL ".join(
        f"""SELECT duplicate_rate, {w} AS workers, max(n) AS largest_worker FROM (
          SELECT duplicate_rate, {'0' if w == 1 else slot('tenant', w)} AS worker, count(*) AS n FROM loaded GROUP BY ALL)
        GROUP BY duplicate_rate""" for w in counts
    )
    settings = [("no dedupe", None, None, 1, None), ("global exact", None, None, 1, None)] + [
        ("filter+exact" if w == 1 else "partitioned filter+exact", e, n, w, FILTERS.index((e, n))) for e, n, w in search.SEARCH_SETTINGS
    ]
    null = {None: "NULL"}
    listed = ", ".join(f"({i}, '{m}', {null.get(e, e)}, {null.get(n, n)}, {w}, {null.get(f, f)})" for i, (m, e, n, w, f) in enumerate(settings))
    order = " ".join(f"WHEN {rate} THEN {i}" for i, rate in enumerate(rates))
    return f"""{before}, {loaded(rates, source)},
counts AS ({filter_counts(window, rates, before, source)}),
load AS ({load}),
settings AS (SELECT * FROM (VALUES {listed}) AS t(place, mode, error_rate, capacity, workers, f)),
totals AS (SELECT duplicate_rate, count(*) AS total, count(DISTINCT fp) AS uniques FROM loaded GROUP BY duplicate_rate),
rated AS (
  SELECT CAST((CASE duplicate_rate {order} END) * {len(settings)} + place + 1 AS INTEGER) AS trial_id, mode, duplicate_rate,
    CAST(error_rate AS DOUBLE) AS error_rate, CAST(capacity AS INTEGER) AS capacity, CAST(workers AS INTEGER) AS workers,
    (SELECT count(*) FROM {source}) AS rows_before, total AS rows_after, total AS total_records,
    coalesce(evaluations, CASE mode WHEN 'no dedupe' THEN total ELSE uniques END) AS evaluations,
    coalesce(false_positives, 0) AS false_positives, largest_worker, uniques
  FROM totals CROSS JOIN settings JOIN load USING (duplicate_rate, workers) LEFT JOIN counts USING (duplicate_rate, f)),
scored AS (
  SELECT * EXCLUDE (uniques), {pct('(total_records - evaluations)', 'total_records')} AS dedupe_rate_pct,
    {pct('(evaluations - false_positives)', 'evaluations')} AS score, {pct('total_records', 'largest_worker * 100')} AS speedup,
    {pct('(total_records - uniques)', 'total_records')} AS exact FROM rated),
trials AS (
  SELECT * EXCLUDE (exact), NOT abs(dedupe_rate_pct - exact) > 5.0 AS valid,
    CASE WHEN abs(dedupe_rate_pct - exact) > 5.0
         THEN printf('%.2f points away from the rate of exact dedupe', abs(dedupe_rate_pct - exact)) ELSE '' END AS notes
  FROM scored)"""


def best(mode: str, config: str, metric: str) -> str:
    return f"""SELECT {config}, round_even(avg({metric}), 4) AS mean_{metric} FROM trials WHERE valid AND mode = '{mode}'
      GROUP BY {config} ORDER BY mean_{metric} DESC, {config} LIMIT 1"""


def confirmed(window: int) -> str:
    """The winners of a search on the validation slice, on the whole table at the rate of the confirmation."""
    slice_ = f"""{FLOWS}, placed AS (SELECT *, row_number() OVER (ORDER BY ts, seq) - 1 AS idx, count(*) OVER () AS n FROM flows),
slice AS (SELECT * FROM placed WHERE idx >= n * 7 // 10 AND idx < n * 8 // 10)"""
    rate = search.CONFIRM_RATE
    worker = " ".join(f"WHEN {w} THEN {slot('tenant', w)}" for _, _, w in search.SEARCH_SETTINGS if w > 1)
    filters = ", ".join(f"({i}, {e}, {n})" for i, (e, n) in enumerate(FILTERS))
    branches = (
        ("no dedupe", "total", "0", "NULL", "NULL", "1", "total"),
        ("global exact", "uniques", "0", "NULL", "NULL", "1", "total"),
        ("filter+exact", "evaluations", "false_positives", "error_rate", "capacity", "1", "total"),
        ("partitioned filter+exact", "evaluations", "false_positives", "error_rate", "capacity", "workers", "busiest"),
    )
    rows = " UNION ALL ".join(
        f"""SELECT '{name}' AS algorithm, total AS total_records, total - {kept} AS duplicates, CAST({hits} AS BIGINT) AS false_positives,
        {kept} AS evaluations, {pct(f'(total - {kept})', 'total')} AS dedupe_rate_pct,
        {rounded(f'{kept} * 50', '100')} / CAST(10000 AS DOUBLE) AS downstream_s,
        {rounded('total * 200000', f'greatest({kept}, 2)')} / CAST(10 AS DOUBLE) AS downstream_rec_s,
        CAST({error} AS DOUBLE) AS error_rate, CAST({capacity} AS INTEGER) AS capacity, CAST({workers} AS INTEGER) AS workers,
        {largest} AS largest_worker FROM chosen"""
        for name, kept, hits, error, capacity, workers, largest in branches
    )
    return f"""WITH RECURSIVE {trials(window, slice_, 'slice')},
plain AS ({best('filter+exact', 'error_rate, capacity', 'score')}),
spread AS (SELECT workers FROM ({best('partitioned filter+exact', 'error_rate, capacity, workers', 'speedup')})),
full_counts AS ({filter_counts(window, [rate], FLOWS, 'flows')}),
{pressured(rate, 'whole')},
chosen AS (
  SELECT *, (SELECT count(*) FROM whole) AS total, (SELECT count(DISTINCT fp) FROM whole) AS uniques,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM whole GROUP BY CASE workers {worker} END)) AS busiest
  FROM plain, spread, full_counts JOIN (VALUES {filters}) AS t(f, e, n) USING (f)
  WHERE CAST(e AS DOUBLE) = error_rate AND n = capacity)
{rows}"""


def config_rows() -> str:
    """Drops per configuration.

    The window of 100,000 and the generation of 20,000 exceed the distinct
    fingerprints of the test tables, so a local exact check drops what first-seen
    per worker drops; the query itself has no such assumption.
    """
    parts = []
    for i, (name, (workers, routing, capacity, _, exact)) in enumerate(search.CONFIGURATIONS.items()):
        key = {"tenant": "tenant", "hash": "fp"}[routing]
        worker = "0" if workers == 1 else slot(key, workers)
        if exact is None and capacity is None:
            accepted = "SELECT count(*) FROM flows"
        elif exact is None:
            size = FilterSize.for_rate(capacity, search.ERROR_RATE)
            accepted = f"""WITH bits AS (SELECT seq, fp, unnest({positions('fp', size)}) AS bit FROM flows),
              set_at AS (SELECT bit, min(seq) AS since FROM bits GROUP BY bit)
              SELECT count(*) FROM (SELECT fp, min(seq) AS s FROM flows GROUP BY fp) JOIN (
                SELECT seq, max(since) < seq AS hit FROM bits JOIN set_at USING (bit) GROUP BY seq) h
              ON h.seq = s WHERE NOT hit"""
        elif exact == "global":
            accepted = "SELECT count(DISTINCT fp) FROM flows"
        else:
            accepted = f"SELECT count(*) FROM (SELECT DISTINCT {worker} AS w, fp FROM flows)"
        parts.append(
            f"""SELECT '{name}' AS config, {workers} AS workers, total AS total_records,
            total - accepted AS dropped, {pct('(total - accepted)', 'total')} AS dup_rate_pct
            FROM (SELECT (SELECT count(*) FROM flows) AS total, ({accepted}) AS accepted)"""
        )
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    w, g, f = c.WINDOW, c.GENERATION, c.FILTER
    flows = f"WITH RECURSIVE {FLOWS}"
    verdict = "SELECT seq, tenant, is_dup"
    scoped = first_seen("tenant, log_type, fp")
    fifo_rows = f"{flows}, {fifo(w)}"
    rotating = f"{flows}, {screened(w, w)}"
    hits = f"{flows}, {filter_hits('tenant', f)}"
    two_stage = f"""{hits}, flagged AS (SELECT *, repeated AS is_dup, CASE WHEN repeated THEN 'duplicate'
      WHEN filter_hit THEN 'filter_false_positive' ELSE 'new' END AS outcome FROM screened)"""
    detection = f"{flows}, {DETECTION}"
    sql = {
        "flow_view": f"{flows} SELECT seq, tenant, log_type, fp, source, destination, fwd_bytes FROM flows",
        "flow_head_n": f"{flows} SELECT seq, tenant, log_type, fp FROM flows ORDER BY seq LIMIT {c.HEAD}",
        "clean_flows": f"{flows} SELECT seq, value, k FROM flows WHERE k NOT IN (3, 4, 5, 6)",
        "parse_event_time": f"""{flows}, texts AS (
          SELECT seq, CASE k % 4 WHEN 0 THEN strftime(ts, '%-d/%-m/%Y %-H:%M') WHEN 1 THEN strftime(ts, '%d/%m/%Y %H:%M:%S')
            WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'unknown' END AS t FROM flows)
          SELECT seq, strftime(coalesce(try_strptime(t, '%d/%m/%Y %H:%M:%S'), try_strptime(t, '%d/%m/%Y %H:%M'),
            try_strptime(t, '%Y-%m-%d %H:%M:%S')), '%Y-%m-%d %H:%M:%S') AS event_time FROM texts""",
        "flow_fingerprint": f"""{flows} SELECT seq, fp, sha256(concat_ws('-', source, destination, fwd_bytes)) AS fp_dash,
          sha256(concat_ws('|', source, destination, '', dst_port, '', '', bwd_packets, fwd_bytes, '')) AS fp_nine
          FROM flows""",
        "flow_scope": f"""{flows} SELECT seq, CASE WHEN k > 9 THEN source ELSE '' END AS tenant,
          destination AS log_type FROM flows""",
        "signature_rules": f"{flows} SELECT seq, {SIGNATURE} AS signature FROM flows",
        "dedupe_none": f"{flows} SELECT seq, tenant, false AS is_dup FROM flows",
        "dedupe_global_exact": f"{flows} {verdict} FROM ({first_seen('fp')})",
        "dedupe_scoped_exact": f"{flows} {verdict} FROM ({scoped})",
        "dedupe_passed": f"{flows} SELECT seq, tenant, fp FROM ({scoped}) WHERE NOT is_dup",
        "dedupe_dropped": f"{flows} SELECT seq, tenant, fp FROM ({scoped}) WHERE is_dup",
        "dedupe_keep_first": f"{flows} SELECT seq, tenant, fp FROM ({scoped}) WHERE NOT is_dup",
        "dedupe_scoped_fifo": f"{fifo_rows} {verdict} FROM flagged",
        "dedupe_scoped_fifo_default": f"{flows} {verdict} FROM ({scoped})",
        "dedupe_scoped_rotating": f"{rotating} {verdict}, outcome FROM flagged",
        "dedupe_hot_scope_fifo": f"""{flows}, hot AS (SELECT seq, destination AS tenant, fp FROM flows),
          {fifo(c.HOT_WINDOW, source='hot')} {verdict} FROM flagged""",
        "dedupe_worker_window": f"""{flows}, routed AS (SELECT *, {slot('fp', 8)} AS worker_id FROM flows),
          {fifo(511, 'worker_id', 'routed')} {verdict}, worker_id FROM flagged""",
        "dedupe_worker_rotating": f"""{flows}, {screened(w, g, on_arrival=True)} {verdict}, outcome FROM flagged""",
        "dedupe_filter_only": f"{hits} SELECT seq, tenant, repeated OR filter_hit AS is_dup FROM screened",
        "dedupe_filter_tumbling": f"""{flows}, {screened(w, w, positions('fp', f), exact=False)}
          {verdict} FROM flagged""",
        "dedupe_two_stage": f"{two_stage} {verdict}, outcome FROM flagged",
        "dedupe_two_stage_windowed": f"""{flows}, {screened(w, w, positions('fp', f))}
          {verdict}, outcome FROM flagged""",
        "dedupe_partitioned_stats": f"""{rotating},
          routed AS (SELECT *, {slot('tenant', c.WORKERS)} AS worker_id FROM flagged)
          SELECT *, total_records AS largest_worker FROM ({stats('routed', 'worker_id', FALSE_HIT)}) UNION ALL
          SELECT *, (SELECT max(n) FROM (SELECT count(*) AS n FROM routed GROUP BY worker_id)) AS largest_worker
          FROM ({stats('routed', '', FALSE_HIT, '-1 AS worker_id, ')})""",
        "route_records": f"""{flows} SELECT seq, {slot('tenant', c.WORKERS)} AS by_tenant,
          {slot('fp', c.WORKERS)} AS by_hash, {slot("'42:' || seq", c.WORKERS)} AS by_random, 0 AS single FROM flows""",
        "dedupe_two_level": f"""{flows}, routed AS (SELECT *, {slot("'42:' || seq", c.WORKERS)} AS worker_id FROM flows)
          SELECT seq, tenant, worker_id, row_number() OVER (PARTITION BY fp ORDER BY seq) > 1 AS is_dup,
            row_number() OVER (PARTITION BY worker_id, fp ORDER BY seq) > 1 AS local_repeat FROM routed""",
        "dedupe_two_level_null_seq": f"""{flows}, numbered AS (
            SELECT CASE k WHEN 5 THEN seq - 1 WHEN 3 THEN NULL ELSE seq END AS seq, tenant, {slot('fp', c.WORKERS)} AS worker_id, fp
            FROM flows)
          SELECT seq, tenant, worker_id, seq IS NOT NULL AND seq NOT IN (
              SELECT min(seq) FROM numbered WHERE seq IS NOT NULL GROUP BY fp) AS is_dup,
            seq IS NOT NULL AND seq NOT IN (
              SELECT min(seq) FROM numbered WHERE seq IS NOT NULL GROUP BY worker_id, fp) AS local_repeat FROM numbered""",
        "dedupe_policy": f"""{flows}, apart AS (SELECT *, tenant || '/' || destination AS place FROM flows),
          {fifo(4, 'place', 'apart')} {verdict} FROM flagged""",
        "dedupe_arrival_lookback": f"""{flows}, pos AS (
          SELECT *, row_number() OVER (PARTITION BY tenant, log_type ORDER BY seq) AS p FROM flows)
          SELECT seq, tenant, {lookback(f"p - {lagged('p')}", w)} AS is_dup FROM pos""",
        "dedupe_ttl": f"""{flows} SELECT seq, tenant,
          {lookback(f"epoch_us(ts) - {lagged('epoch_us(ts)')}", c.TTL_SECONDS * 1_000_000)} AS is_dup FROM flows""",
        "dedupe_ttl_disordered": f"""{flows}, moved AS (SELECT seq, tenant, fp,
            CASE WHEN k <> 6 THEN ts + to_hours(CAST((k * 5) % 11 AS INTEGER)) END AS ts FROM flows)
          SELECT seq, tenant, coalesce(ts IS NOT NULL AND epoch_us(ts) - lag(epoch_us(ts)) OVER (
              PARTITION BY tenant, fp, ts IS NULL ORDER BY ts, seq) <= {c.TTL_SECONDS * 1_000_000}, false) AS is_dup
          FROM moved""",
        "carried_fingerprints": f"{flows} {verdict} FROM ({scoped})",
        "dedupe_scoped_fifo_null_scope": f"""{flows}, nameless AS (
            SELECT seq, CASE WHEN CAST(tenant AS BIGINT) % 3 <> 0 THEN tenant END AS tenant,
              CASE WHEN CAST(tenant AS BIGINT) % 3 <> 0 THEN tenant ELSE '' END AS named, fp FROM flows),
          {fifo(w, 'named', 'nameless')} {verdict} FROM flagged""",
        "dedupe_stats": f"{flows}, flagged AS ({scoped}) {stats('flagged')}",
        "dedupe_scan_cost": f"""{flows}, flagged AS ({first_seen('fp')})
          SELECT *, CAST(evaluations AS DOUBLE) * (evaluations + 1) / 2 AS scan_comparisons FROM ({stats('flagged')})""",
        "dedupe_state_size": f"""{fifo_rows} SELECT count(*) AS scopes, CAST(sum(cached) AS BIGINT) AS cached_fingerprints,
          CAST(sum(cached * 40 + {(f.bits + 7) // 8}) AS BIGINT) AS state_bytes FROM (
            SELECT tenant, least({w}, count(*)) AS cached FROM flagged WHERE NOT is_dup GROUP BY tenant)""",
        "window_sweep": f"WITH RECURSIVE {FLOWS} " + " UNION ALL ".join(
            f"""SELECT '{name}' AS semantics, {size} AS window_size, * FROM (
              WITH RECURSIVE {FLOWS}, {body(size)} {stats('flagged', '', hits_of)})"""
            for size in (4, 16, 64)
            for name, body, hits_of in (
                ("fifo", fifo, "0"),
                ("rotating", lambda n: screened(n, n), FALSE_HIT),
            )
        ),
        "partition_sweep": f"""{flows}, flagged AS ({scoped}) """ + " UNION ALL ".join(
            f"""SELECT {n} AS workers, workers_used, total_records, duplicates,
              {pct('duplicates', 'total_records')} AS dedupe_rate_pct
            FROM (SELECT count(DISTINCT {'0' if n == 1 else slot('tenant', n)}) AS workers_used, count(*) AS total_records,
              CAST(sum(CASE WHEN is_dup THEN 1 ELSE 0 END) AS BIGINT) AS duplicates FROM flagged)"""
            for n in (1, 2, 4)
        ),
        "config_matrix": f"{flows} {config_rows()}",
        "config_ranking": f"{flows} SELECT * FROM ({config_rows()}) ORDER BY dup_rate_pct DESC, config",
        "trial_log": f"WITH RECURSIVE {trials(c.SEARCH_WINDOW)} SELECT * FROM trials",
        "best_config": f"""WITH RECURSIVE {trials(c.SEARCH_WINDOW)} {best('filter+exact', 'error_rate, capacity', 'score')}""",
        "best_partitioned_config": f"""WITH RECURSIVE {trials(c.SEARCH_WINDOW)}
          {best('partitioned filter+exact', 'error_rate, capacity, workers', 'speedup')}""",
        "confirm_search": confirmed(c.SEARCH_WINDOW),
        "efficiency_report": f"""{two_stage} SELECT total_records, round_even(total_records / CAST(2 AS DOUBLE), 2) AS throughput_rec_s,
          round_even(CAST(2000000 AS DOUBLE) / total_records, 2) AS avg_latency_us, dedupe_rate_pct AS dedup_rate_pct,
          {pct('false_positives', 'total_records')} AS bloom_fp_rate_pct FROM ({stats('flagged', '', FALSE_HIT)})""",
        "duplicate_pressure": f"{flows}, {pressured(0.5, 'loaded')} SELECT seq, origin, tenant, fp FROM loaded",
        "chronological_index": f"{detection} SELECT seq, idx FROM ordered",
        "chronological_split": f"{detection} SELECT seq, split FROM marked",
        "train_only_scaling": f"{detection} SELECT seq, round_even(z_value, 6) AS z_value, round_even(z_k, 6) AS z_k FROM scaled",
        "sequence_windows": f"""{detection} SELECT seq, label, CAST(length AS INTEGER) AS length, history,
            round_even(value, 4) AS next_value, round_even(CAST(k AS DOUBLE), 4) AS next_k FROM (
          SELECT *, count(*) OVER w AS length, string_agg(concat_ws(':', CAST(round_even(value * 100, 0) AS BIGINT), k * 100), ',') OVER w AS history
          FROM marked WINDOW w AS (PARTITION BY split ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
          WHERE length = 10""",
        "forecast_mean": f"""{detection} SELECT seq, round_even(p_z_value, 6) AS p_z_value,
          round_even(p_z_k, 6) AS p_z_k FROM residuals""",
        "forecast_linear": f"""{detection}, {autoregression()} SELECT seq, split, round_even(sqrt(
            (z_value - p_z_value) * (z_value - p_z_value) + (z_k - p_z_k) * (z_k - p_z_k)), 6) AS residual FROM forecasts""",
        "forecast_residual": f"{detection} SELECT seq, split, round_even(residual, 6) AS residual FROM residuals",
        "vector_residual": """WITH pairs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a,
            CAST(lag(embedding) OVER (ORDER BY vec_id) AS DOUBLE[]) AS b FROM embeddings)
          SELECT vec_id, round_even(sqrt(list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(a, b)])), 4) AS residual
          FROM pairs WHERE b IS NOT NULL""",
        "anomaly_threshold": f"{detection} SELECT round_even(tau, 6) AS tau, benign_rows FROM threshold",
        "anomaly_flags": f"{detection} SELECT seq, anomaly FROM verdicts",
        "hybrid_fusion": f"{detection} SELECT seq, signature, anomaly, hybrid FROM verdicts",
        "detector_comparison": f"{detection} SELECT model, {report()} FROM (" + " UNION ALL ".join(
            f"SELECT '{m}' AS model, {confusion('label', m)} FROM verdicts" for m in c.DETECTORS
        ) + ")",
        "confusion_matrix": f"{flows} SELECT {confusion('label', 's')} FROM (SELECT label, {SIGNATURE} AS s FROM flows)",
        "classification_report": f"SELECT {report()} FROM (SELECT {confusion('toxic', '1 - quality')} FROM labels)",
        "fused_signature_report": f"""{flows} SELECT {report()} FROM (SELECT {confusion('label', 's')} FROM (
          SELECT label, CASE WHEN {SIGNATURE} = 1 THEN 1 WHEN value > 50 THEN 1 ELSE 0 END AS s FROM flows))""",
        "stream_fifo": f"{fifo_rows} {verdict}, destination FROM flagged",
        "stream_ttl_dedupe": f"""{flows} SELECT seq, tenant,
          {lookback(f"epoch_us(ts) - {lagged('epoch_us(ts)')}", c.TTL_SECONDS * 1_000_000)} AS is_dup FROM flows""",
        "stream_fifo_state": f"{fifo_rows} {verdict} FROM flagged",
        "stream_rotating": f"{rotating} {verdict}, outcome FROM flagged",
        "stream_signature_rules": f"{flows} SELECT seq, {SIGNATURE} AS signature FROM flows",
        "stream_dedupe_stats": f"{fifo_rows} {stats('flagged')}",
    }
    sql["stream_ttl_bounded_state"] = sql["stream_ttl_dedupe"]
    sql["detector_comparison_csv"] = sql["detector_comparison"]
    settings = [(e, n) for e in (0.01, 0.05) for n in (1000, 5000)]
    sql["filter_error_sweep"] = f"{flows}, firsts AS (SELECT fp, min(seq) AS seq FROM flows GROUP BY fp) " + " UNION ALL ".join(
        f"""SELECT '{e}/{n}' AS setting, unique_records, false_positives,
          {pct('false_positives', 'unique_records')} AS fp_rate_pct FROM (
          WITH {filter_hits('', FilterSize.for_rate(n, e), 'firsts')}
          SELECT count(*) AS unique_records, CAST(sum(CASE WHEN filter_hit THEN 1 ELSE 0 END) AS BIGINT) AS false_positives
          FROM screened)"""
        for e, n in settings
    )
    # At the default window of 100,000 the windowed forms equal first-seen here.
    branches = {
        "no dedupe": ("SELECT false AS is_dup FROM flows", "0"),
        "global exact": (first_seen("fp"), "0"),
        "filter only": ("SELECT repeated OR filter_hit AS is_dup FROM screened", "0"),
        "filter+exact": ("SELECT * FROM flagged", FALSE_HIT),
        "partitioned filter+exact": (scoped, "0"),
    }
    sql["dedupe_comparison"] = f"{two_stage} " + " UNION ALL ".join(
        f"""SELECT *, '{name}' AS algorithm, {rounded('evaluations * 50', '100')} / CAST(10000 AS DOUBLE) AS downstream_s,
          {rounded('total_records * 200000', 'greatest(evaluations, 2)')} / CAST(10 AS DOUBLE) AS downstream_rec_s
          FROM ({stats(f'({rows})', '', false_hits)})"""
        for name, (rows, false_hits) in branches.items()
    )
    sql["result_file"] = sql["dedupe_comparison"]
    return sql
