"""SQL twins of the registered queries, over the same tables."""

from __future__ import annotations

from ..functions.safety import SENSITIVE_PATTERNS
from ..operators.shapes import LIBRARY_FRAME
from ..sources.rules import SEEDS
from . import fixtures as fx

SECTION = 1 << 58
KEEP = 1 << 61
BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TOKEN = r"""[^\s\x0b\x1c-\x1f\x{85}\p{Z}/\\_.\-:=@()\[\]{},;!?#&|<>"''`~^*+]+"""


def _lines(doc: str, order: str, line: str, table: str) -> str:
    return (
        f"lines as (select {doc} as doc_id, row_number() over (partition by {doc} order by {order}) - 1 as pos, "
        f"{line} as line from {table})"
    )


def _events(line: str = "event_type") -> str:
    return _lines("user_id", "event_id", line, "events")


DIFF = _lines("l_suppkey", "l_orderkey, l_linenumber, l_partkey", fx.DIFF_LINE, "lineitem")
PATHS = _lines("p_size % 5", "p_partkey", fx.PATH_LINE, "part")
PAIRS = _lines("c_nationkey", "c_custkey", fx.PAIR_LINE, "customer")
TABLE = f"""body as (select o_custkey % 100 as doc_id, row_number() over (partition by o_custkey % 100 order by o_orderkey) + 1 as pos,
    {fx.TABLE_LINE} as line from orders),
  lines as (select * from body
    union all select distinct doc_id, 0, 'ORDER   STATUS   PRIORITY   A   B   C' from body
    union all select distinct doc_id, 1, '-----   ------   --------   -   -   -' from body)"""
COMMANDS = " ".join(f"when '{k}' then '{v}'" for k, v in fx.SOURCE_COMMANDS.items())
OUTPUTS = f"outputs as (select doc_id, case source {COMMANDS} else 'unknown tool' end as command, text as output from documents)"
ARRAYS = f"""arrays as (select doc_id, command, output, case when output = '' then []::varchar[] else
    string_split_regex(regexp_replace(output, '({BREAK})$', ''), '{BREAK}') end as parts from outputs)"""
DOC_LINES = f"""{OUTPUTS}, {ARRAYS},
  lines as (select doc_id, unnest(range(len(parts))) as pos, unnest(parts) as line from arrays)"""


def _tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{TOKEN}'))"


def _runs(source: str, keys: str = "doc_id") -> str:
    return f"""marked as (select *, case when line = lag(line) over (partition by {keys} order by pos) then 0 else 1 end as is_new from {source}),
  numbered as (select *, sum(is_new) over (partition by {keys} order by pos rows unbounded preceding) as run from marked),
  runs as (select {keys}, run, min(line) as line, min(pos) as pos, count(*) as cnt from numbered group by {keys}, run)"""


def _collapsed(source: str, least: int) -> str:
    return f"""{_runs(source)},
  folded as (select doc_id, pos, line || ' [repeated ' || cnt || 'x]' as line from runs where cnt >= {least}
    union all select doc_id, pos + i, line from (select *, unnest(range(cnt)) as i from runs where cnt < {least}))"""


def _head_tail(source: str, most: int, head: int, tail: int, unit: str = "lines", short: bool = False, order: str = "pos") -> str:
    """Ends of each document; limits are given after clamping."""
    if not short:
        tail = max(tail, 1)
    shown = f"n <= {most} or " if short else ""
    return f"""ranked as (select doc_id, line, row_number() over (partition by doc_id order by {order}) as i,
    count(*) over (partition by doc_id) as n from {source}),
  shown as (select doc_id, 2 * i as ord, line from ranked where {shown}i <= {head} or i > n - {tail}
    union all select doc_id, {2 * head + 1}, '... [' || (n - {head} - {tail}) || ' more {unit}]' from ranked
    where i = 1 and n > {most} and n - {head} - {tail} > 0)"""


def _kept(pattern: str) -> str:
    return f"""union all select doc_id, min(pos) + {KEEP}, line from lines where regexp_matches(line, '{pattern}')
    and (doc_id, line) not in (select (doc_id, line) from shown) group by doc_id, line"""


_sensitive = " or ".join(f"regexp_matches({{0}}, '(?i){p}')" for p in SENSITIVE_PATTERNS)


def _is_sensitive(column: str) -> str:
    return "(" + _sensitive.replace("{0}", column) + ")"


REASON = f"""case when starts_with(trim(command), 'docker logs') then 'command in user blocklist'
    when {_is_sensitive('command')} or {_is_sensitive('output')} then 'security sensitive content detected'
    when len(parts) < {{0}} then 'minimal output' end"""

SAMPLE = f"""{OUTPUTS}, {ARRAYS}, sample as (select doc_id, command, len(parts[:200]) as n, parts[:200] as ls, array_to_string(parts[:200], chr(10)) as s from arrays),
  counted as (select *,
    list_sum([length(x) for x in ls]) / n as mean,
    len(s) - len(replace(s, ':', '')) as colons,
    len([x for x in ls if regexp_matches(x, '^[+-]([^+-]|$)')]) as changed,
    len(regexp_extract_all(s, '\\d+%')) + len(regexp_extract_all(s, '\\d+/\\d+')) as fractions,
    regexp_matches(s, '(?i)downloading|fetching|step|layer') as words,
    regexp_matches(s, 'PASSED|FAILED|ERROR|ok|FAIL') as tests,
    len(regexp_extract_all(lower(s), 'test')) as names,
    len([x for x in ls[greatest(1, n - 4):] if contains(x, '====')]) > 0 as rule,
    contains(s, '@@') as hunks, contains(s, '---') or contains(s, '+++') as marks,
    len(regexp_extract_all(s, '(?m)^[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_\\s]+:\\s+\\S')) as kv1,
    len(regexp_extract_all(s, '(?m)^[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_\\s]+=\\s*\\S')) as kv2,
    contains(s, 'File "') or contains(s, 'at line') as frames,
    contains(s, 'Traceback') or contains(s, 'Exception') as trace,
    coalesce(regexp_full_match(ls[2], '[-\\s|+]+'), false) as second_rule,
    ls[1] = upper(ls[1]) and ls[1] <> lower(ls[1]) as first_upper,
    [len(regexp_extract_all(x, '\\s{{2,}}|\\t|\\|')) + 1 for x in ls[:10] if trim(x, ' ' || chr(9)) <> ''] as cols,
    len([i for i in range(1, n) if (contains(ls[i], 'File "') or contains(ls[i], 'at line')) and starts_with(ls[i + 1], '    ')]) > 0 as code
    from sample),
  pts as (select doc_id, command, n,
    case when n > 20 then 0.3::double else 0.0::double end
      + case when n >= 5 and len([x for x in ls if abs(length(x) - mean) <= 20]) / n > 0.8::double then 0.3::double else 0.0::double end
      + case when n >= 5 and colons / n < 0.2::double then 0.2::double else 0.0::double end
      + case when n >= 5 and changed = 0 then 0.2::double else 0.0::double end
      + case when n < 5 and colons = 0 and changed = 0 then 0.2::double else 0.0::double end as list,
    case when fractions > 0 then 0.4::double else 0.0::double end + case when words then 0.3::double else 0.0::double end
      + case when n > 10 and fractions > n * 0.5::double then 0.3::double else 0.0::double end
      + case when n <= 10 and fractions > 0 and words then 0.1::double else 0.0::double end as progress,
    case when tests then 0.5::double else 0.0::double end + case when names / n > 0.2::double then 0.3::double else 0.0::double end
      + case when rule then 0.2::double else 0.0::double end as test,
    case when changed / n > 0.1::double then 0.6::double else 0.0::double end + case when hunks then 0.3::double else 0.0::double end
      + case when marks then 0.1::double else 0.0::double end as diff,
    case when n >= 2 and second_rule then 0.5::double else 0.0::double end
      + case when n >= 3 and len(cols) >= 3 and cols[-1] > 1 and cols[-1] = cols[-2] and cols[-2] = cols[-3] then 0.3::double else 0.0::double end
      + case when first_upper then 0.2::double else 0.0::double end as "table",
    kv1 / n > 0.6::double as many1, kv2 / n > 0.6::double as many2,
    case when trace then 0.5::double else 0.0::double end + case when frames then 0.3::double else 0.0::double end
      + case when frames and code then 0.2::double else 0.0::double end as error
    from counted),
  scores as (select doc_id, command, least(1.0::double, list) as list, least(1.0::double, progress) as progress, least(1.0::double, test) as test,
    least(1.0::double, diff) as diff, least(1.0::double, "table") as "table",
    case when many1 then 0.5::double else 0.0::double end + case when many2 then 0.3::double else 0.0::double end
      + case when progress < 0.2::double and test < 0.2::double then 0.2::double else 0.0::double end as keyvalue,
    least(1.0::double, error) as error from pts where n > 0),
  best as (select *, greatest(list, progress, test, diff, "table", keyvalue, error) as top from scores),
  detected as (select doc_id, command, case when top < 0.5 then 'generic' when list = top then 'list' when progress = top then 'progress'
    when test = top then 'test' when diff = top then 'diff' when "table" = top then 'table' when keyvalue = top then 'keyvalue'
    else 'error' end as shape, case when top < 0.5 then 0.0::double else round(top, 2) end as confidence from best
    union all select doc_id, command, 'generic', 0.0::double from sample where n = 0)"""

SEED_ROWS = "seeds(prefix, strategy, max_lines, head_lines, max_rows, keep, streamable) as (values " + ", ".join(
    "('{}', '{}', {}, {}, {}, {}, {})".format(
        prefix,
        strategy,
        params.get("max_lines", "null::int"),
        params.get("head_lines", "null::int"),
        params.get("max_rows", "null::int"),
        f"'{params['keep']}'" if "keep" in params else "null",
        str(stream).lower(),
    )
    for prefix, strategy, params, stream in SEEDS
) + ")"
USER_ROWS = """users(prefix, max_lines, head_lines, max_rows, strip) as
  (values ('git', 7, null::int, null::int, 'qu'), ('git log', null, 3, null, 'th'), ('docker', 12, null, 4, ''))"""


def _matched(rules: str, into: str, source: str = "outputs") -> str:
    return f"""{into} as (select o.doc_id, arg_max(r, length(r.prefix)) as r from {source} o
    left join {rules} r on o.command = r.prefix or starts_with(o.command, r.prefix || ' ') group by o.doc_id)"""


CALLS = """calls as (select 'cmd ' || user_id as command, event_id as seq,
    case when user_id % 3 = 0 then 'list' when event_type = 'error' then 'error'
      when event_type = 'view' and user_id % 3 = 1 then 'table' else 'list' end as shape,
    100 + event_id % 900 as raw, 50 + event_id % 400 as comp, event_id // 16 as session_id, ts from events)"""
FOLD = f"""recursive {CALLS},
  ordered as (select *, row_number() over (partition by command order by seq) as i from calls),
  fold as (select command, 1 as i, shape as strategy, 0.5::double as confidence from ordered where i = 1
    union all
    select f.command, f.i + 1,
      case when f.confidence >= 0.95::double or f.strategy = o.shape or f.confidence - 0.2::double >= 0.5::double then f.strategy else o.shape end,
      case when f.confidence >= 0.95::double then f.confidence
        when f.strategy = o.shape then least(1.0::double, f.confidence + 0.08::double)
        when f.confidence - 0.2::double < 0.5::double then 0.5::double else f.confidence - 0.2::double end
    from fold f join ordered o on o.command = f.command and o.i = f.i + 1),
  learned as (select command, arg_max(strategy, i) as strategy, arg_max(confidence, i) as confidence, max(i) as calls from fold group by command),
  registry as (select l.command, 'learned' as source, l.strategy, l.calls, l.confidence, l.calls >= 10 and l.confidence >= 0.85 as hot,
    (select max(ts) from calls c where c.command = l.command) as last_seen from learned l),
  usable as (select * from registry where confidence >= 0.85 or (calls >= 3 and confidence >= 0.65))"""
EVENT_COMMANDS = "asked as (select event_id as doc_id, 'cmd ' || (event_id % 200) || case when event_id % 4 = 0 then ' -v' else '' end as command from events)"
ENTRY = "command, source, strategy, calls, confidence, hot, last_seen"

PROGRESS_MARKS = f"""kinds as (select *, regexp_matches(line, '(?i)error|fail|exception') as is_error,
    (regexp_matches(line, '^\\s*\\d+%\\s*$') or (contains(line, '%') and length(line) < 15)
      or regexp_matches(line, '(?i)eta|speed|\\d+\\s*[kmg]b/s')) as is_noise from lines)"""


def _progress(all_lines: bool) -> str:
    plain = "union all select doc_id, line, pos as ord from kinds where not is_error and not is_noise" if all_lines else ""
    return f"""{PROGRESS_MARKS}, parts as (select doc_id, line, pos + {SECTION} as ord from kinds where is_error {plain}
    union all select doc_id, arg_max(line, pos), max(pos) + {2 * SECTION} from kinds group by doc_id)
  select doc_id, min(ord) as ord, line from parts group by doc_id, line"""


def _test(limit: int) -> str:
    return f"""tails as (select *, row_number() over (partition by doc_id order by pos desc) as back from lines),
  hits as (select *, regexp_matches(line, '(?i)^={{3,}}|^-{{3,}}\\s*$|\\btotal:|\\bpassed:|\\bfailed:')
    or ((contains(lower(line), 'failed') or contains(lower(line), 'passed')) and contains(line, '====')) as hit from tails where back <= 5),
  summary as (select doc_id, pos, line from hits h where hit or (back = 1 and not exists (select 1 from hits g where g.doc_id = h.doc_id and g.hit))),
  rest as (select * from lines where (doc_id, line) not in (select (doc_id, line) from summary)),
  kinds as (select *, case when regexp_matches(line, '\\b(FAILED|FAIL|ERROR)\\b') then 'f' when regexp_matches(line, '\\b(PASSED|ok)\\b') then 'p' else 'o' end as kind from rest),
  blocks as (select *, sum(case when kind <> 'o' then 1 else 0 end) over (partition by doc_id order by pos rows unbounded preceding) as block from kinds),
  placed as (select *, row_number() over (partition by doc_id, block order by pos) - 1 as i, first_value(kind) over (partition by doc_id, block order by pos) as opener from blocks),
  body as (select doc_id, pos, case when i = {limit + 1} then '... [traceback truncated]' else line end as line from placed where block > 0 and opener = 'f' and i <= {limit + 1}),
  once as (select *, contains(line, 'AssertionError:') or contains(line, 'expect(') as said, row_number() over (partition by doc_id, line order by pos) as k from body)
  select doc_id, pos as ord, line from once where not said or k = 1
  union all select doc_id, pos + {SECTION}, line from summary"""

DIFF_FLAGS = """flags as (select *, starts_with(line, '+++') or starts_with(line, '---') or starts_with(line, '@@') as header,
    (starts_with(line, '+') or starts_with(line, '-')) and not (starts_with(line, '+++') or starts_with(line, '---')) as changed from lines)"""


def _diff_near(k: int) -> str:
    return f"""near as (select *, max(changed::int) over (partition by doc_id order by pos rows between {k} preceding and {k} following) as close from flags),
  context as (select doc_id, pos, line from near where (header or close = 1) and not starts_with(line, 'index '))"""


DIFF_FILES = """numbered as (select *, sum(starts_with(line, '+++ b/')::int) over (partition by doc_id order by pos rows unbounded preceding) as no from lines),
  per_file as (select doc_id, no, max(case when starts_with(line, '+++ b/') then substr(line, 7) end) as file, min(pos) as pos,
    sum((starts_with(line, '+') and not starts_with(line, '+++'))::int) as added,
    sum((starts_with(line, '-') and not starts_with(line, '---'))::int) as deleted from numbered where no > 0 group by doc_id, no),
  files as (select doc_id, file, min(pos) as pos, arg_max(added, no) as added, arg_max(deleted, no) as deleted from per_file where file <> '' group by doc_id, file)"""

def _diff(most: int) -> str:
    return f"""{DIFF_FLAGS}, {_diff_near(2)}, {DIFF_FILES}, sizes as (select doc_id, count(*) as kept from context group by doc_id),
        long as (select doc_id from sizes where kept > {most} and doc_id in (select doc_id from files))
        select doc_id, pos as ord, line from context where doc_id not in (select doc_id from long)
        union all select doc_id, -1, '[Diff too large, summarized by file]' from long
        union all select doc_id, pos, file || ': +' || added || ' -' || deleted from files where doc_id in (select doc_id from long)"""


def _error(limit: int) -> str:
    return f"""kinds as (select *, case when contains(line, 'Traceback') or contains(line, 'Exception') then 'h'
    when contains(line, 'File "') or contains(line, 'at line') or starts_with(trim(line), 'at ') then 'f'
    when starts_with(line, '    ') then 'c' else 'm' end as kind from lines where trim(line) <> ''),
  states as (select *, last_value(case when kind in ('h', 'm') then kind end ignore nulls) over
    (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as state from kinds),
  inside as (select *, kind <> 'h' and coalesce(state = 'h', false) as is_in from states),
  cands as (select doc_id, pos, line, case when line = lag(line) over (partition by doc_id order by pos) then 0 else 1 end as chg
    from inside where is_in and kind = 'f' and not regexp_matches(line, '{LIBRARY_FRAME.replace('(?iu)', '(?i)')}')),
  ranks as (select *, sum(chg) over (partition by doc_id order by pos rows unbounded preceding) as rank from cands),
  frames as (select doc_id, pos, line from ranks where chg = 1 and rank <= {limit}
    union all select doc_id, min(pos), '... [additional frames omitted]' from ranks where rank - chg >= {limit} group by doc_id),
  rows_ as (select doc_id, pos, line, true as lead from inside where not is_in or kind = 'm' union all select doc_id, pos, line, true from frames
    union all select doc_id, pos, line, false from inside where is_in and kind = 'c'),
  cuts as (select *, last_value(case when lead or contains(line, 'omitted') then contains(line, 'omitted') end ignore nulls) over
    (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as cut from rows_),
  kept as (select *, lag(line) over (partition by doc_id order by pos) as before from cuts where lead or not coalesce(cut, false))
  select doc_id, pos as ord, line from kept where not (contains(line, 'Caused by') and coalesce(line = before, false))"""

RESULTS = """results as (select o_orderkey as doc_id, 'cmd ' || (o_custkey % 50) as command,
    case when o_orderstatus = 'F' then 'list' else 'generic' end as strategy, 'classifier' as source,
    o_orderpriority || ' ' || o_orderkey as raw_output, o_orderpriority as compressed_output,
    o_orderkey % 100 + 5 as raw_tokens, o_orderkey % 5 + 1 as compressed_tokens, o_orderdate as created_at from orders),
  history as (select row_number() over (order by created_at, doc_id) as id, * exclude (doc_id) from results)"""

EVENTS_IN = f"""{OUTPUTS}, tools as (select doc_id, command,
    case when doc_id % 10 in (2, 3) then 'deny' when doc_id % 10 = 4 then 'block' else 'tool_result' end as dialect,
    case doc_id % 10 when 1 then case when contains(output, 'late error') then output else output || chr(10) || 'late error' end
      when 3 then output || chr(10) || 'tail' else output end as output
    from outputs where doc_id % 10 in (0, 1, 2, 3, 4, 7, 9) and output <> '')"""

# the whole rule: gate, resolve, condense by strategy, second chance, regression guard

LIST_PARAMS = """case prefix when 'git log' then {'m': 20, 'h': 16, 't': 4} when 'git stash' then {'m': 10, 'h': 8, 't': 2}
    when 'docker logs' then {'m': 30, 'h': 12, 't': 18} when 'cat' then {'m': 50, 'h': 20, 't': 5} else {'m': 30, 'h': 20, 't': 5} end"""
LISTS = f"""filled as (select * from lines where regexp_matches(line, '\\S')),
  repeats as (select doc_id, pos, line from filled where doc_id in (select doc_id from live where prefix = 'docker logs')),
  {_runs('repeats')},
  dirs as (select *, regexp_replace(line, '/[^/]*$', '') as dir from filled
    where doc_id in (select doc_id from live where prefix = 'find') and contains(line, '/')),
  folders as (select doc_id, dir, count(*) as files, min(pos) as grp from dirs group by doc_id, dir),
  shown_rows as (
    select doc_id, 0 as part, 0 as grp, pos, case when cnt > 1 then line || ' [repeated ' || cnt || 'x]' else line end as line from runs
    union all select d.doc_id, 1, grp, pos, line from dirs d join folders f on d.doc_id = f.doc_id and d.dir = f.dir where files <= 3
    union all select doc_id, 1, grp, grp, dir || '/... [' || files || ' files]' from folders where files > 3
    union all select doc_id, 0, 0, pos, line from filled where doc_id in (select doc_id from live where prefix = 'find') and not contains(line, '/')
    union all select doc_id, 0, 0, pos, line from filled where doc_id in (select doc_id from live where prefix not in ('find', 'docker logs'))),
  ranked as (select s.doc_id, line, {LIST_PARAMS} as k, row_number() over (partition by s.doc_id order by part, grp, pos) as i,
    count(*) over (partition by s.doc_id) as n from shown_rows s join live on s.doc_id = live.doc_id)
  select doc_id, 2 * i as ord, line from ranked where n <= k.m or i <= k.h or i > n - k.t
  union all select doc_id, 2 * k.h + 1, '... [' || (n - k.h - k.t) || ' more items]' from ranked where i = 1 and n > k.m"""
TABLES = """below as (select *, lead(line) over (partition by doc_id order by pos) as nx from lines),
  heads as (select doc_id, coalesce(min(case when (upper(line) = line and lower(line) <> line)
    or regexp_full_match(coalesce(nx, ''), '[-\\s|+]+') then pos end), 0) as header from below group by doc_id),
  placed as (select l.*, pos <= header or regexp_full_match(line, '[-\\s|+]+') as as_is from lines l join heads using (doc_id)),
  data as (select *, row_number() over (partition by doc_id order by pos) as i, string_split_regex(line, '\\s{2,}|\\t') as c,
    regexp_extract_all(line, '\\s{2,}|\\t') as g from placed where not as_is and regexp_matches(line, '\\S')),
  limits as (select doc_id, case prefix when 'docker ps' then 15 else 20 end as m from live)
  select doc_id, pos as ord, line from placed where as_is
  union all select d.doc_id, pos, case when i = m + 1 then '... [additional rows omitted]' else array_to_string([case when length(c[x]) > 40
    then c[x][:37] || '...' else c[x] end || coalesce(g[x], '') for x in range(1, least(len(c), 5) + 1)], '') end
    from data d join limits using (doc_id) where i <= m + 1"""
WORD = "[\\p{L}\\p{N}_]"
PAIR_ROWS = f"""keyed as (select *, case when regexp_matches(line, '^\\s*{WORD}[\\p{{L}}\\p{{N}}_\\s]*:\\s+\\S') then regexp_extract(line, '^(\\s*{WORD}[\\p{{L}}\\p{{N}}_\\s]*):\\s+\\S', 1)
    when regexp_matches(line, '^\\s*{WORD}[\\p{{L}}\\p{{N}}_\\s]*=\\s*\\S') then regexp_extract(line, '^(\\s*{WORD}[\\p{{L}}\\p{{N}}_\\s]*)=\\s*\\S', 1) end as key from lines),
  rest as (select *, key is null or not regexp_matches(key, '(?i)time|date|at') as important from keyed),
  ranked as (select r.*, case prefix when 'git status' then 15 else 20 end as most, row_number() over (partition by r.doc_id order by pos) as i,
    row_number() over (partition by r.doc_id, important order by pos) as j, count(*) over (partition by r.doc_id) as n,
    sum(important::int) over (partition by r.doc_id) as m from rest r join live on r.doc_id = live.doc_id)
  select doc_id, pos as ord, line from ranked where n <= most or (important and j <= most)
  union all select distinct doc_id, {SECTION}, case when m > most then '... [additional pairs omitted]' else '... [timestamp pairs omitted]' end from ranked where n > most"""
CLEAN = "clean as (select doc_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as line from lines where regexp_matches(line, '\\S'))"


def _part(strategy: str, body: str, filled: bool = False) -> str:
    blank = " and regexp_matches(line, '\\S')" if filled else ""
    return f"""select doc_id, string_agg(line, chr(10) order by ord) as text from (with
  lines as (select doc_id, pos, line from all_lines where doc_id in (select doc_id from live where strategy = '{strategy}'){blank}), {body})
  group by doc_id"""


def _generic(most: int, head: int, tail: int) -> str:
    return f"{CLEAN}, {_collapsed('clean', 3)}, {_head_tail('folded', most, head, tail)} select doc_id, ord, line from shown"


PARTS = " union all ".join(
    [
        _part("generic", _generic(50, 20, 10)),
        _part("list", LISTS),
        _part("progress", _progress(False), filled=True),
        _part("test", _test(8), filled=True),
        _part("diff", _diff(80)),
        _part("table", TABLES),
        _part("keyvalue", PAIR_ROWS),
        _part("error", _error(10)),
    ]
)
CONDENSED = f"""{SAMPLE}, {SEED_ROWS}, {_matched('seeds', 'found')},
  gated as (select doc_id, case when {_is_sensitive('command')} or {_is_sensitive('output')} then 'security sensitive content detected'
    when len(parts) < 15 then 'minimal output' end as reason from arrays),
  live as (select a.doc_id, a.command, a.output, a.parts, coalesce(f.r.strategy, d.shape) as strategy, coalesce(f.r.prefix, '') as prefix,
    case when f.r.strategy is null then 'classifier' else 'seed' end as source, greatest(1, {_tokens('a.output')}) as raw_tokens
    from arrays a join gated using (doc_id) join found f using (doc_id) join detected d using (doc_id) where reason is null),
  all_lines as (select doc_id, unnest(range(len(parts))) as pos, unnest(parts) as line from live),
  condensed as (select doc_id, text, greatest(1, {_tokens('text')}) as tokens from ({PARTS}) where text <> ''),
  sized as (select doc_id, raw_tokens, coalesce(tokens, raw_tokens) as tokens from live left join condensed using (doc_id)),
  low as (select * from sized where raw_tokens > 200 and 1 - tokens / raw_tokens < 0.1::double),
  again as (select doc_id, text, greatest(1, {_tokens('text')}) as tokens from (select doc_id, string_agg(line, chr(10) order by ord) as text from (with
    lines as (select * from all_lines where doc_id in (select doc_id from low)), {_generic(20, 12, 6)}) group by doc_id) where text <> ''),
  chosen as (select l.doc_id, case when a.tokens < z.tokens then a.text else c.text end as text,
    case when a.tokens < z.tokens then a.tokens else c.tokens end as tokens
    from live l left join condensed c using (doc_id) left join again a using (doc_id) left join low z using (doc_id)),
  judged as (select l.*, b.text, b.tokens, b.text is null or length(b.text) > length(l.output) or b.tokens > l.raw_tokens as grew from live l join chosen b using (doc_id)),
  results as (select o.doc_id, j.command as live_command, reason, strategy, source, raw_tokens, case when grew then raw_tokens else tokens end as compressed_tokens,
    case when reason is not null or grew then o.output else j.text end as result
    from outputs o join gated using (doc_id) left join judged j using (doc_id))"""
RESULT_COLUMNS = "doc_id, reason, strategy, source, raw_tokens, compressed_tokens, result"

LADDER = " union all ".join(
    f"select doc_id, {i} as rung, string_agg(line, chr(10) order by ord) as text from (with lines as (select * from all_lines where doc_id in (select doc_id from over)), {_generic(n, h, t)}) group by doc_id"
    for i, (n, h, t) in enumerate([(60, 36, 18), (40, 24, 12), (30, 18, 9), (20, 12, 6), (15, 9, 4), (10, 6, 3)])
)

CALLED = OUTPUTS.replace("case source", """case when doc_id % 3 = 0 then 'cmd ' || (doc_id % 200)
    when doc_id % 3 = 1 then 'cmd ' || (doc_id % 200) || ' -v' else case source""").replace("end as command", "end end as command")
REGISTRY_CONDENSED = (
    CONDENSED.replace(OUTPUTS, CALLED)
    .replace("coalesce(f.r.strategy, d.shape)", "coalesce(f.r.strategy, u.strategy, d.shape)")
    .replace("case when f.r.strategy is null then", "case when f.r.strategy is null and u.strategy is not null then 'learned' when f.r.strategy is null then")
    .replace("join detected d using (doc_id) where", "join detected d using (doc_id) left join usable u on u.command = a.command where")
)
BASES = """bases as (select split_part(command, ' ', 1) || ' ' || split_part(command, ' ', 2) as base_key,
    arg_max(strategy, {'t': last_seen, 'c': command}) as strategy from usable where hot group by 1)"""

TOOL_OUTPUTS = f"""{EVENTS_IN.replace('outputs', 'documents_out')}, outputs as (select doc_id, command, output from tools
    where not (length(output) < 200 and length(output) - length(replace(output, chr(10), '')) < 3))"""
TOOL_CONDENSED = CONDENSED.replace(OUTPUTS, TOOL_OUTPUTS)

ESCAPED = """escaped as (select event_id, case when event_id % 3 = 0 then event_type || ' ' || event_id
    else chr(27) || '[3' || (event_id % 8) || 'm' || event_type || chr(27) || '[0m ' || event_id end as line from events)"""
LOOSE = "regexp_replace(trim('  ' || p_brand || '   ' || p_type || chr(9) || p_name || ' '), '\\s+', ' ', 'g')"

CHUNKS = """chunks as (select user_id as run_id, event_id as seq, ts, 'chunk ' || event_type || case when event_id % 3 = 0 then chr(10) else '' end as chunk from events)"""
SEGMENTS = f"""{CHUNKS}, gaps as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by run_id order by ts, seq) >= 21600000000 then 1 else 0 end as stall from chunks),
  segments as (select *, sum(stall) over (partition by run_id order by ts, seq rows unbounded preceding) as segment from gaps)"""

RUN_SEGMENTS = SEGMENTS.replace(CHUNKS, """chunks as (select user_id as run_id, event_id as seq, ts,
    array_to_string(list_transform(range(event_id % 30 + 1), lambda i: 'line ' || (i % 4) || ' ' || event_type || chr(10)), '') as chunk from events)""").replace("21600000000", "7200000000")
SEGMENT_OUTPUTS = f"""{RUN_SEGMENTS}, run_sizes as (select run_id, segment, sum(strlen(chunk)) as n from segments group by run_id, segment),
  outputs as (select run_id * 1000000 + segment as doc_id, 'unknown tool' as command, string_agg(chunk, '' order by ts, seq) as output
    from segments join run_sizes using (run_id, segment) where n <= 2000 group by run_id, segment)"""
SEGMENTS_CONDENSED = f"""with {CONDENSED.replace(OUTPUTS, SEGMENT_OUTPUTS)}
    select cast(doc_id // 1000000 as bigint) as run_id, cast(doc_id % 1000000 as bigint) as segment, 0::bigint as part, reason, strategy, source, raw_tokens, compressed_tokens, result from results
    union all select run_id, segment, seq, 'output exceeds the size limit', null, null, null, null, chunk from segments join run_sizes using (run_id, segment) where n > 2000"""

ENTRIES = """entries as (select 'f' || (p_partkey % 3) || '.json' as file, 'tool ' || (p_partkey // 3) as prefix, p_partkey % 7 as kind, p_size from part)"""

ORACLES: dict[str, str] = {
    "read_outputs": "select conv_id * 1000 + turn as doc_id, role as command, text as output from conversations",
    "split_lines": f"with {DOC_LINES} select doc_id, pos, line from lines",
    "has_ansi": f"with {ESCAPED} select event_id, contains(line, chr(27)) as has_ansi from escaped",
    "strip_ansi": "select event_id, event_type || ' ' || event_id as line from events",
    "normalize_command": f"select p_partkey, {LOOSE} as command from part",
    "base_command_key": f"select p_partkey, split_part({LOOSE}, ' ', 1) || ' ' || split_part({LOOSE}, ' ', 2) as base_key from part",
    "count_tokens": f"select doc_id, greatest(1, {_tokens('text')}) as tokens from documents",
    "size_guard": "select doc_id, strlen(text) > 2000 as oversize from documents",
    "blocklisted": f"with {OUTPUTS} select doc_id, starts_with(command, 'git') or starts_with(command, 'npm r') as hit from outputs",
    "sensitive_command": "select event_id, event_id % 5 = 0 or event_type in ('printenv', 'declare', 'env', 'set', 'history', 'fc') as hit from events",
    "sensitive_text": f"select page_id, {_is_sensitive('html')} or regexp_matches(html, '(?i)lorem\\d') as hit from pages",
    "is_binary": """select doc_id, case when text = '' then false when doc_id % 7 = 0 then
        (len(regexp_extract_all(substr(text, 1, 4096), '[aeiou]')) + len(regexp_extract_all(substr(text, 1, 4096), '[\\p{C}\\p{Z}]'))
         - len(regexp_extract_all(substr(text, 1, 4096), '[ \\n\\r\\t]'))) / length(substr(text, 1, 4096)) > 0.2::double else
        (len(regexp_extract_all(substr(text, 1, 4096), '[\\p{C}\\p{Z}]')) - len(regexp_extract_all(substr(text, 1, 4096), '[ \\n\\r\\t]')))
         / length(substr(text, 1, 4096)) > 0.2::double end as binary from documents""",
    "is_minimal": f"with {OUTPUTS}, {ARRAYS} select doc_id, len(parts) < 15 as minimal from arrays",
    "skip_reason": f"with {OUTPUTS}, {ARRAYS} select doc_id, {REASON.replace('{0}', '12')} as reason from arrays",
    "safety_report": f"with {OUTPUTS}, {ARRAYS} select coalesce({REASON.replace('{0}', '12')}, '') as reason, count(*) as n_outputs from arrays group by 1",
    "shape_scores": f"""with {SAMPLE} select doc_id, list, progress, test, diff, "table", keyvalue, error from scores
        union all select doc_id, null, null, null, null, null, null, null from sample where n = 0""",
    "detect": f"with {SAMPLE} select doc_id, shape, confidence from detected",
    "shape_profile": f"with {SAMPLE} select command, shape, count(*) as n_outputs, avg(confidence) as avg_confidence from detected group by command, shape",
    "match_seed": f"with {OUTPUTS}, {SEED_ROWS}, {_matched('seeds', 'found')} select doc_id, r.prefix as prefix, r.strategy as strategy from found",
    "match_override": f"with {OUTPUTS}, {USER_ROWS}, {_matched('users', 'found')} select doc_id, r.prefix as prefix from found",
    "merge_params": f"""with {OUTPUTS}, {SEED_ROWS}, {USER_ROWS}, {_matched('seeds', 'a')}, {_matched('users', 'b')}
        select a.doc_id, coalesce(b.r.max_lines, a.r.max_lines) as max_lines, coalesce(b.r.head_lines, a.r.head_lines) as head_lines,
        coalesce(b.r.max_rows, a.r.max_rows) as max_rows, a.r.keep as keep from a join b on a.doc_id = b.doc_id""",
    "merge_contracts": f"""with {OUTPUTS}, {USER_ROWS}, {_matched('users', 'found')}
        select doc_id, case when coalesce(r.strip, '') = '' then '^error' else '^error,' || r.strip end as strip from found""",
    "lookup_registry": f"with {FOLD}, {EVENT_COMMANDS} select doc_id, strategy from asked left join usable using (command)",
    "lookup_base_key": f"""with {FOLD}, {EVENT_COMMANDS},
        bases as (select split_part(command, ' ', 1) || ' ' || split_part(command, ' ', 2) as base_key, arg_max(strategy, last_seen) as strategy from usable where hot group by 1)
        select doc_id, strategy from asked left join bases on split_part(command, ' ', 1) || ' ' || split_part(command, ' ', 2) = base_key""",
    "resolve_strategy": f"""with {SAMPLE}, {SEED_ROWS}, {_matched('seeds', 'found')}
        select d.doc_id, coalesce(f.r.strategy, d.shape) as strategy, case when f.r.strategy is null then 'classifier' else 'seed' end as source
        from detected d join found f on d.doc_id = f.doc_id""",
    "resolve_with_registry": f"""with {FOLD}, {SAMPLE.replace(OUTPUTS, CALLED)}, {SEED_ROWS}, {_matched('seeds', 'found')}
        select d.doc_id, coalesce(f.r.strategy, u.strategy, d.shape) as strategy,
          case when f.r.strategy is not null then 'seed' when u.strategy is not null then 'learned' else 'classifier' end as source
        from detected d join found f on d.doc_id = f.doc_id join outputs o on o.doc_id = d.doc_id left join usable u on u.command = o.command""",
    "resolve_with_base_keys": f"""with {FOLD}, {SAMPLE.replace(OUTPUTS, CALLED)}, {SEED_ROWS}, {_matched('seeds', 'found')}, {BASES}
        select d.doc_id, coalesce(b.strategy, f.r.strategy, u.strategy, d.shape) as strategy,
          case when b.strategy is not null then 'learned' when f.r.strategy is not null then 'seed' when u.strategy is not null then 'learned' else 'classifier' end as source
        from detected d join found f on d.doc_id = f.doc_id join outputs o on o.doc_id = d.doc_id left join usable u on u.command = o.command
          left join bases b on split_part(o.command, ' ', 1) || ' ' || split_part(o.command, ' ', 2) = b.base_key""",
    "condense_with_registry": f"with {FOLD}, {REGISTRY_CONDENSED} select {RESULT_COLUMNS} from results",
    "streamable_rule": f"""with {OUTPUTS}, {SEED_ROWS}, {_matched('seeds', 'found')} select o.doc_id, o.command from outputs o join found f on o.doc_id = f.doc_id
        where f.r.streamable and f.r.strategy = 'progress'""",
    "valid_extensions": f"""with {ENTRIES} select file, prefix, case kind when 1 then 'unknown strategy' when 2 then 'unknown keys' when 3 then 'params must be a mapping'
        when 4 then 'streamable must be a bool' when 5 then 'not a mapping' end as reason from entries""",
    "seed_table": f"""with {ENTRIES}, {SEED_ROWS}, good as (select *, row_number() over (partition by prefix order by file desc) as k from entries where kind in (0, 6))
        select prefix, strategy, max_lines, streamable, false as user_override from seeds
        union all select prefix, case kind when 0 then 'list' else 'progress' end, case kind when 0 then p_size end, kind = 6, true from good where k = 1""",
    "collapse_runs": f"with {_events()}, {_collapsed('lines', 2)} select doc_id, pos, line from folded",
    "head_tail": f"with {_events()}, {_head_tail('lines', 60, 8, 4)} select doc_id, ord, line from shown",
    "generic": f"""with {_events()}, {_collapsed('lines', 3)}, emitted as (select * from folded where not regexp_matches(line, 'repeated 3x')),
        {_head_tail('emitted', 50, 20, 10)} select doc_id, ord, line from shown {_kept('^purch')}""",
    "generic_documents": f"""with {DOC_LINES}, clean as (select doc_id, pos, trim(line) as line from lines where trim(line) <> ''), {_collapsed('clean', 3)},
        {_head_tail('folded', 20, 13, 7)} select doc_id, ord, line from shown""",
    "list_lines": f"""with {_events()}, {_collapsed('lines', 2)}, {_head_tail('folded', 20, 16, 4, 'items', True)},
        joined as (select doc_id, ord, line from shown {_kept('^signup$')}) select doc_id, ord, line from joined where not regexp_matches(line, 'repeated 2x')""",
    "group_by_directory": f"""with {PATHS}, dirs as (select *, regexp_replace(line, '/[^/]*$', '') as dir from lines where contains(line, '/')),
        folders as (select doc_id, dir, count(*) as files, min(pos) as grp from dirs group by doc_id, dir)
        select d.doc_id, 1 as part, grp, pos, line from dirs d join folders f on d.doc_id = f.doc_id and d.dir = f.dir where files <= 3
        union all select doc_id, 1, grp, grp, dir || '/... [' || files || ' files]' from folders where files > 3
        union all select doc_id, 0, 0, pos, line from lines where not contains(line, '/')""",
    "list_directories": f"""with {PATHS}, dirs as (select *, regexp_replace(line, '/[^/]*$', '') as dir from lines where contains(line, '/')),
        folders as (select doc_id, dir, count(*) as files, min(pos) as grp from dirs group by doc_id, dir),
        grouped as (select d.doc_id, 1 as part, grp, pos, line from dirs d join folders f on d.doc_id = f.doc_id and d.dir = f.dir where files <= 3
          union all select doc_id, 1, grp, grp, dir || '/... [' || files || ' files]' from folders where files > 3),
        {_head_tail('grouped', 40, 20, 5, 'items', True, 'part, grp, pos')} select doc_id, ord, line from shown""",
    "progress": f"with {_events(fx.PROGRESS_LINE)}, {_progress(False)}",
    "progress_all": f"with {_events(fx.PROGRESS_LINE)}, {_progress(True)}",
    "test_run": f"with {_events(fx.TEST_LINE)}, {_test(2)}",
    "diff_context": f"with {DIFF}, {DIFF_FLAGS}, {_diff_near(1)} select doc_id, pos, line from context",
    "diff_stat": f"with {DIFF}, {DIFF_FILES} select doc_id, file, pos, added, deleted from files",
    "diff": f"with {DIFF}, {_diff(560)}",
    "table": f"""with {TABLE}, data as (select *, row_number() over (partition by doc_id order by pos) as i from lines where pos > 1),
        cells as (select doc_id, pos, i, string_split(line, '   ') as c from data)
        select doc_id, pos as ord, line from lines where pos <= 1
        union all select doc_id, pos, case when i = 21 then '... [additional rows omitted]' else
          array_to_string([case when length(x) > 8 then x[:5] || '...' else x end for x in c[:5]], '   ') || '   ' end from cells where i <= 21""",
    "keyvalue": f"""with {PAIRS}, pairs as (select *, regexp_extract(line, '^(\\s*\\w[\\w\\s]*):\\s+\\S', 1) as key from lines),
        rest as (select *, not regexp_matches(key, '(?i)time|date|at') as important from pairs where not regexp_matches(key, '^Na')),
        ranked as (select *, row_number() over (partition by doc_id order by pos) as i, row_number() over (partition by doc_id, important order by pos) as j,
          count(*) over (partition by doc_id) as n, sum(important::int) over (partition by doc_id) as m from rest)
        select doc_id, pos as ord, line from ranked where (n <= 42) or (n > 42 and important and j <= 42)
        union all select distinct doc_id, {SECTION}, case when m > 42 then '... [additional pairs omitted]' else '... [timestamp pairs omitted]' end from ranked where n > 42""",
    "error_trace": f"with {_events(fx.TRACE_LINE)}, {_error(3)}",
    "always_keep": f"with {_events()}, {_head_tail('lines', 12, 4, 2)} select doc_id, ord, line from shown {_kept('^sign|error$')}",
    "always_strip": f"with {_events()} select doc_id, pos, line from lines where not regexp_matches(line, '^view$|chase')",
    "fit_lines": f"""with {DOC_LINES}, used as (select *, sum({_tokens('line')}) over (partition by doc_id order by pos rows unbounded preceding) as t from lines)
        select doc_id, string_agg(line, chr(10) order by pos) || chr(10) || '... [token budget reached]' as text from used where t + 3 <= 60 group by doc_id""",
    "fit_words": f"""with words as (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos from (select doc_id, regexp_extract_all(text, '\\S+') as w from documents)),
        used as (select *, sum({_tokens('word')}) over (partition by doc_id order by pos rows unbounded preceding) as t from words)
        select doc_id, string_agg(word, ' ' order by pos) as text from used where pos = 0 or greatest(1, t) <= 25 group by doc_id""",
    "fit_to_budget": f"""with {DOC_LINES}, over as (select doc_id from documents where {_tokens('text')} > 40),
        used as (select *, sum({_tokens('line')}) over (partition by doc_id order by pos rows unbounded preceding) as t from lines),
        a as (select doc_id, string_agg(line, chr(10) order by pos) || chr(10) || '... [token budget reached]' as text from used where t + 3 <= 40 group by doc_id),
        words as (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos from (select doc_id, regexp_extract_all(text, '\\S+') as w from documents)),
        wused as (select *, sum({_tokens('word')}) over (partition by doc_id order by pos rows unbounded preceding) as t from words),
        b as (select doc_id, string_agg(word, ' ' order by pos) as text from wused where pos = 0 or greatest(1, t) <= 40 group by doc_id)
        select doc_id, coalesce(a.text, b.text) as text from over left join a using (doc_id) left join b using (doc_id)""",
    "learn_fold": f"with {FOLD} select command, strategy, confidence from learned",
    "learn_fold_segments": f"with {FOLD} select command, strategy, confidence from learned",
    "learn_averages": f"with {CALLS} select command, count(*) as calls, avg(raw) as avg_raw_tokens, avg(comp) as avg_compressed_tokens, max(ts) as last_seen from calls group by command",
    "merge_registry": f"with {FOLD} select {ENTRY} from registry",
    "hot_flag": f"with {FOLD} select command from registry where hot",
    "reset_commands": f"""with {FOLD}, chosen as (select 'cmd ' || (c_custkey * 3) as command from customer)
        select command, source, strategy, case when c then 0 else calls end as calls, case when c then 0.5::double else confidence end as confidence,
        hot and not c as hot, last_seen from (select *, command in (select command from chosen) as c from registry)""",
    "registry_entries": f"with {FOLD} select {ENTRY} from registry",
    "registry_summary": f"""with {FOLD} select (select count(*) from registry) as total_learned, (select sum(greatest(0, raw - comp)) from calls) as total_tokens_saved,
        (select sum(hot::int) from registry) as n_hot""",
    "session_count": f"with {CALLS} select count(distinct session_id) as session_count from calls",
    "history_append": f"""with {RESULTS}, parted as (select *, doc_id % 2 as half from results),
        ids as (select row_number() over (order by half, created_at, doc_id) as id, * exclude (doc_id, half) from parted) select * from ids order by id desc limit 100""",
    "history_latest": f"with {RESULTS} select * from history where command = 'cmd 7' order by id desc limit 1",
    "history_latest_each": f"with {RESULTS} select h.* from history h where id in (select max(id) from history group by command)",
    "history_by_id": f"with {RESULTS} select * from history where id = 1234",
    "history_recent": f"with {RESULTS} select id, command, strategy, source, raw_tokens, compressed_tokens, created_at from history order by id desc limit 25",
    "restore": f"with {RESULTS} select id, command, compressed_output as text from history where id in (select max(id) from history where command in ('cmd 3', 'cmd 4') group by command)",
    "normalize_tool_events": f"with {EVENTS_IN} select doc_id, dialect, command, output from tools",
    "already_transformed": "select doc_id from documents where doc_id % 10 = 6",
    "fast_exit": f"with {EVENTS_IN} select doc_id, length(output) < 200 and length(output) - length(replace(output, chr(10), '')) < 3 as fast from tools",
    "tool_envelopes": f"""with {EVENTS_IN} select doc_id, case dialect when 'tool_result' then '{{"type":"tool_result","content":"' || command || '"}}'
        else '{{"decision":"' || dialect || '","reason":"' || command || '"}}' end as value from tools""",
    "assemble_chunks": f"""with {CHUNKS}, runs as (select run_id, string_agg(chunk, '' order by seq) as text from chunks group by run_id),
        parts as (select run_id, string_split(text, chr(10)) as p from runs)
        select run_id, pos, line from (select run_id, len(p) as n, unnest(range(len(p))) as pos, unnest(p) as line from parts) where pos < n - 1 or trim(line) <> ''""",
    "stall_segments": f"with {SEGMENTS} select run_id, segment, count(*) as n_chunks, sum(strlen(chunk)) as n_bytes, min(ts) as started, max(ts) as ended from segments group by run_id, segment",
    "segment_outputs": f"with {SEGMENTS} select run_id, segment, 0::bigint as part, string_agg(chunk, '' order by ts, seq) as output, cast(null as varchar) as reason from segments group by run_id, segment",
    "segment_outputs_large": f"""with {SEGMENTS}, sizes as (select run_id, segment, sum(strlen(chunk)) as n from segments group by run_id, segment)
        select run_id, segment, 0::bigint as part, string_agg(chunk, '' order by ts, seq) as output, cast(null as varchar) as reason from segments join sizes using (run_id, segment) where n <= 14 group by run_id, segment
        union all select run_id, segment, seq, chunk, 'output exceeds the size limit' from segments join sizes using (run_id, segment) where n > 14""",
    "stream_progress_filter": f"select user_id as run_id, event_id as seq, ts, {fx.PROGRESS_LINE} as line from events where event_type = 'error'",
    "stream_final_line": f"""with every as (select user_id as run_id, event_id as seq, ts, {fx.PROGRESS_LINE} as line, event_type not in ('error', 'view', 'click') as sig from events),
        gaps as (select *, case when ts - lag(ts) over (partition by run_id order by ts, seq) < interval 6 hour then 0 else 1 end as is_new from every),
        parts as (select *, sum(is_new) over (partition by run_id order by ts, seq rows unbounded preceding) as part from gaps),
        wins as (select run_id, part, min(ts) as started, max(ts) + interval 6 hour as ended, arg_max(line, seq) filter (where sig) as line from parts group by run_id, part)
        select run_id, started, ended, line from wins where line is not null""",
    "condense_segments": SEGMENTS_CONDENSED,
    "stream_condense_segments": SEGMENTS_CONDENSED,
    "stream_stall_segments": f"with {SEGMENTS} select run_id, min(ts) as started, max(ts) as ended, count(*) as n_chunks, sum(strlen(chunk)) as n_bytes from segments group by run_id, segment",
    "stream_safe_emit": "select user_id as run_id, event_id as seq, ts, event_type as line from events where event_id % 5 >= 2",
    "stream_learn": f"with {FOLD} select {ENTRY} from registry",
    "condense_outputs": f"with {CONDENSED} select {RESULT_COLUMNS} from results",
    "stream_condense": f"with {CONDENSED} select {RESULT_COLUMNS} from results",
    "min_savings": f"with {CONDENSED.replace('< 0.1::double)', '< 0.9::double)')} select doc_id, compressed_tokens, result from results",
    "condense_tool_events": f"""with {TOOL_CONDENSED} select r.doc_id, t.dialect as mark, r.result as text from results r join tools t using (doc_id)
        union all select doc_id, 'tool_result', text from documents where doc_id % 10 = 6""",
    "savings": f"""with {CONDENSED} select live_command as command, strategy, count(*) as n_outputs, sum(raw_tokens) as raw_tokens, sum(compressed_tokens) as compressed_tokens,
        sum(greatest(0, raw_tokens - compressed_tokens)) as saved, 1 - sum(compressed_tokens) / sum(raw_tokens) as ratio from results where reason is null group by 1, 2""",
    "budget_ladder": f"""with {DOC_LINES.replace('lines as', 'all_lines as')}, over as (select doc_id, {_tokens('output')} as now from outputs where {_tokens('output')} > 300),
        rungs as (select doc_id, rung, text, greatest(1, {_tokens('text')}) as tokens from ({LADDER}) where text <> ''),
        stops as (select doc_id, min(case when tokens <= 300 then rung end) as stop from rungs group by doc_id),
        tried as (select r.* from rungs r join stops s using (doc_id) where stop is null or rung <= stop),
        best as (select *, row_number() over (partition by doc_id order by tokens, rung) as k from tried)
        select doc_id, text, tokens from best join over using (doc_id) where k = 1 and tokens < now""",
    "regression_guard": f"""with {DOC_LINES}, {_head_tail('lines', 4, 1, 1)},
        texts as (select doc_id, string_agg(line, chr(10) order by ord) as text from shown group by doc_id)
        select doc_id, case when text is null or text = '' or length(text) > length(output) or greatest(1, {_tokens('text')}) > greatest(1, {_tokens('output')})
          then output else text end as result from outputs left join texts using (doc_id)""",
    "error_passthrough": f"""with {OUTPUTS}, {ARRAYS.replace('arrays as', 'flat as')}
        select doc_id, case when {_is_sensitive('command')} or {_is_sensitive('output')} then 'security sensitive content detected'
          when doc_id % 2 = 0 and 3 + case when output = '' then 0 else 2 * len(parts) - (not regexp_matches(output, '\\n$'))::int end >= 15 then 'error output pass-through'
          when doc_id % 2 = 0 or len(parts) < 15 then 'minimal output' end as reason from flat""",
}
ORACLES["stream_assemble_chunks"] = ORACLES["assemble_chunks"]
ORACLES["stream_shown_lines"] = f"""select run_id, 'error' as kind, ts as started, ts, line from ({ORACLES["stream_progress_filter"]})
    union all select run_id, 'final', started, ended, line from ({ORACLES["stream_final_line"]})"""
ORACLES["assemble_chunks_parts"] = f"""select run_id, pos, cast(i as bigint) as part, substring(line, i * 20 + 1, 20) as line
    from (select *, unnest(range(greatest(1, (length(line) + 19) // 20))) as i from ({ORACLES["assemble_chunks"]}))"""
ORACLES["stream_tool_events"] = f"select mark, text from ({ORACLES['condense_tool_events']})"
_LEFT = "case when doc_id % 4 = 0 then null else {0} end as {0}"
ORACLES["bypass"] = f"""with {CONDENSED} select doc_id, case when doc_id % 4 = 0 then 'bypass' else reason end as reason,
    {", ".join(_LEFT.format(c) for c in ("strategy", "source", "raw_tokens", "compressed_tokens"))},
    case when doc_id % 4 = 0 then o.output else result end as result from results join outputs o using (doc_id)"""
ORACLES["nonempty_guard"] = f"""with {CONDENSED} select doc_id, reason, strategy, source, raw_tokens, raw_tokens as compressed_tokens, o.output as result
    from results join outputs o using (doc_id)"""
ORACLES |= {"history_store": ORACLES["history_append"], "history_store_by_id": ORACLES["history_by_id"], "registry_store": ORACLES["merge_registry"]}
ORACLES |= {
    f"{name}_segments": ORACLES[name]
    for name in (
        "collapse_runs", "generic", "progress", "test_run", "diff", "table", "keyvalue", "error_trace", "assemble_chunks", "segment_outputs"
    )
}
