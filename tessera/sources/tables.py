"""Reading tables and projecting them onto the code-index model: files, call edges, queue, events, symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A file's repository and path, as every view over documents has them.
_FILE = """concat('/ws/', source) as repo_root,
  concat(case when doc_id % 5 = 0 then 'src/' when doc_id % 5 = 1 then 'tests/' when doc_id % 5 = 2 then 'app/core/' else 'lib/' end, lang, '/doc_', cast(doc_id as {string}),
    case when doc_id % 4 = 0 then '.py' when doc_id % 4 = 1 then '.java' when doc_id % 4 = 2 then '.md' else '.lock' end) as relative_path"""
FILES = f"""select {_FILE}, '/ws' as scope_repo_root,
  doc_id, n_chars as size_bytes, {{hash}} as content_hash, (doc_id % 17 = 0) as is_deleted, lang,
  case when doc_id % 6 = 0 then 'PENDING' when doc_id % 6 = 1 then 'BODY_READY' when doc_id % 6 = 2 then 'LSP_READY' when doc_id % 6 = 3 then 'L3_SKIPPED' when doc_id % 6 = 4 then 'FAILED' else 'TOOL_READY' end as enrich_state,
  text from documents"""
#: Layers of a file's analysis, each at the content hash that it was made from; some are of an older hash.
_HASH = "case when doc_id % {stale} = 0 then 'older' else {{hash}} end as content_hash"
L4 = f"select {_FILE}, doc_id, {_HASH.format(stale=13)}, cast(case when doc_id % 3 = 0 then 0.35 else 0.9 end as double) as confidence, doc_id % 3 = 0 as degraded from documents where doc_id % 4 <> 3"
L5 = (f"select {_FILE}, {_HASH.format(stale=11)}, case when doc_id % 2 = 0 then 'low_confidence' else 'interactive' end as reason_code, cast(doc_id % 6 as {{string}}) as relations from documents where doc_id % 5 < 2"
      f" union all select {_FILE}, {_HASH.format(stale=11)}, 'refresh' as reason_code, '0' as relations from documents where doc_id % 15 = 0")
READY = f"select {_FILE}, {_HASH.format(stale=7)}, doc_id % 2 = 0 as callers_ready from documents where doc_id % 9 <> 0"
CALLS = f"""select {_FILE}, {_HASH.format(stale=19)}, concat('fn_', lang, cast(doc_id % 50 as {{string}})) as from_symbol, case when doc_id % 3 = 0 then null else concat('src/', lang, '/caller_', cast(doc_id % 30 as {{string}}), '.py') end as caller_relative_path,
  case when doc_id % 10 = 0 then 'run_job' else concat('pkg', cast(doc_id % 3 as {{string}}), case when doc_id % 4 = 0 then '.' when doc_id % 4 = 1 then '::' when doc_id % 4 = 2 then '#' else '_' end, source) end as to_symbol,
  n_chars % 50 as line, cast(doc_id % 8 as double) / 8 as confidence from documents"""
EDGES = """select concat('/ws/supp', cast(l_suppkey as {string})) as repo_root, concat('m', cast(l_linenumber as {string}), '.py') as relative_path,
  case when l_linenumber % 3 = 0 then null else concat('caller_', cast(l_orderkey % 97 as {string}), '.py') end as caller_relative_path,
  concat('fn_', cast(l_orderkey as {string})) as from_symbol, concat('sym_', cast(l_partkey as {string})) as to_symbol, l_linenumber as line, cast(l_discount as double) as confidence from lineitem"""
QUEUE = """select o_orderkey as job_id, concat('/ws/c', cast(o_custkey % 20 as {string})) as repo_root, cast(substr(o_orderpriority, 1, 1) as int) * 15 as priority,
  case when o_orderkey % 11 = 0 then 'DEAD' when o_orderkey % 7 = 0 then 'RUNNING' when o_orderkey % 5 = 0 then 'FAILED' when o_orderkey % 2 = 0 then 'DONE' else 'PENDING' end as status,
  case when o_orderkey % 3 = 0 then concat('l5:heavy_', cast(o_orderkey % 4 as {string})) when o_orderkey % 3 = 1 then 'budget' else null end as defer_reason, o_orderdate as created_at, o_totalprice from orders"""
JOBS = "select event_id, user_id, ts, event_type, case when event_type = 'error' then 'DEAD' else 'DONE' end as status, value as latency_ms from events"
SYMBOLS = """select concat('sym_', cast(p_partkey as {string})) as symbol_key, p_name as name, case p_partkey % 5 when 0 then 'class' when 1 then 'function' when 2 then 'interface' when 3 then 'method' else 'field' end as kind,
  p_size % 4 as depth, p_brand as container_name, case when p_partkey >= 10 then concat('sym_', cast(floor(p_partkey / 10) as {whole})) end as parent_key, p_partkey as line, concat('m', cast(p_partkey % 7 + 1 as {string}), '.py') as relative_path from part"""
#: Source files of four languages, one a part.
SOURCES = """select concat('/ws/r', cast(p_partkey % 5 as {string})) as repo_root, p_partkey,
  concat('src/m', cast(p_partkey % 7 as {string}), '/f', cast(p_partkey as {string}), case p_partkey % 4 when 0 then '.py' when 1 then '.java' when 2 then '.ts' else '.scala' end) as relative_path,
  case p_partkey % 4 when 0 then 'python' when 1 then 'java' when 2 then 'typescript' else 'scala' end as lang,
  replace(replace(replace(case p_partkey % 4
    when 0 then concat('import os||class Part', cast(p_partkey as {string}), '(Base):|', repeat('    def area(self):|        return size(1)||', cast(p_size % 3 + 1 as int)), 'def build_', cast(p_partkey % 10 as {string}), '(x):|    pass|')
    when 1 then concat('package p;||public class Part', cast(p_partkey as {string}), ' ~|', repeat('  public static int total(int x) ~|    return sum(x);|  ^|', cast(p_size % 3 + 1 as int)), '|  new Thing(1);|  List<String> names(int a) ~^|  void größe() ~^|^|')
    when 2 then concat('export class Part', cast(p_partkey as {string}), ' ~^|', repeat('export async function load(a) ~|^|', cast(p_size % 3 as int)), '|function tail(a) ~^|')
    else concat('package a.b|final case class Part', cast(p_partkey as {string}), '(x: Int)|', repeat('  def get(i: Int) = i|  lazy val v = 1|', cast(p_size % 3 as int)), 'object Main|') end, '|', chr(10)), '~', chr(123)), '^', chr(125)) as text from part"""
#: What another analyser knows of those files: shifted lines, other spellings and kinds, and symbols that the outline lacks.
KNOWN = f"""select relative_path, lang, name, kind, line, line + p_partkey % 3 as end_line from (
  select *, concat('Part', cast(p_partkey as {{string}}), case when p_partkey % 4 = 1 then '<T>' else '' end) as name, '5' as kind, p_partkey % 6 + 1 as line from ({SOURCES})
  union all select *, case p_partkey % 4 when 0 then 'area' when 1 then 'total(int x)' when 2 then 'load' else 'get' end as name, case p_partkey % 4 when 0 then '6' when 2 then '12' else 'method' end as kind, p_partkey % 11 + 2 as line from ({SOURCES})
  union all select *, case p_partkey % 4 when 1 then 'new Thing' when 3 then 'v' else 'extra' end as name, case p_partkey % 4 when 1 then '9' when 3 then 'variable' else '13' end as kind, 4 as line from ({SOURCES})
  union all select *, case p_partkey % 8 when 1 then 'Outer$In' when 5 then 'PartBuilder' else 'Main' end as name, '5' as kind, 9 as line from ({SOURCES})) as known"""
#: Python files, six of a group (numbered by its first part): routes, an application, a service, a broken file, protocols, classes.
_G = "cast(p_partkey - p_partkey % 6 as {string})"
PYFILES = f"""select concat('/ws/py', cast((p_partkey - p_partkey % 6) % 5 as {{string}})) as repo_root, p_partkey, {_G} as g,
  concat(case p_partkey % 6 when 0 then 'api/r' when 1 then case when p_partkey % 4 = 1 then 'tests/app' else 'web/app' end when 2 then 'svc/s' when 3 then 'svc/b' when 4 then 'core/d' else 'core/i' end, {_G}, case when p_partkey % 6 = 4 then '/ports.py' else '.py' end) as relative_path,
  replace(replace(replace(replace(replace(case p_partkey % 6
    when 0 then 'from lib import APIRouter|router = APIRouter()|%router.get("/x")|def read_@():|    pass|%router.other|def skip():|    pass|%app.post|def write():|    pass|'
    when 1 then 'from api.r@ import router as sub|def build(app):|    app.include_router(sub)|    app.add_api_route("/p", handlers.show)|    return [Route("/q", endpoint=home), Route("/z")]|'
    when 2 then 'class Service@:|    def __init__(self, repo: db.Repo, n):|        self.repo = repo|        self.tool = tools.Tool()|        self.table = ~"a": self.tool.call, "b": plain^|    def run(self, x):|        tool = self.tool|        tool.call(1)|        self.repo.find(2)|        go = self.table["a"]|        go(3)|        return self.table["b"](x)|'
    when 3 then 'def broken(:|'
    when 4 then 'class Store@(Protocol):|    def load@(self, key):|        ...|    def save(self, key, *, force):|        ...|    def _hidden(self):|        ...|class Empty(Protocol):|    pass|'
    else 'class Disk(ports.Store@):|    pass|class Mem:|    def load@(self, key):|        pass|    def save(self, key, *, force):|        pass|class Wrong:|    def load@(self, name):|        pass|    def save(self, key, *, force):|        pass|' end,
  '|', chr(10)), '~', chr(123)), '^', chr(125)), '@', {_G}), '%', '@') as text from part"""
VIEWS = {"pyfiles": PYFILES, "sources": SOURCES, "known": KNOWN, "files": FILES, "edges": EDGES, "queue": QUEUE, "jobs": JOBS, "symbols": SYMBOLS, "l4": L4, "l5": L5, "ready": READY, "calls": CALLS}
_TABLES = {"pyfiles": "part", "sources": "part", "known": "part", "files": "documents", "edges": "lineitem", "queue": "orders", "jobs": "events", "symbols": "part"} | dict.fromkeys(("l4", "l5", "ready", "calls"), "documents")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Views whose rows are much wider than those of their table, or cost much more, and rows of the table that one task takes of them.
_WIDE = ("pyfiles", "sources", "known")
TASK_ROWS = 20_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt over as many tasks as their number asks for. A table of many million such rows is a few MB of parquet, which Spark
    reads in one task or a few; all that is then made of each row (a text to be parsed) would stay there."""
    tasks = -(-rows.count() // TASK_ROWS)  # from the files' footers
    return rows.repartition(tasks, key) if tasks > 1 else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model table over the given parquet tables; columns that a query does not use are never read."""
    text = VIEWS[name].format(string="string", whole="string", hash="sha2(text, 256)").replace(f"from {_TABLES[name]}", "from {rows}")
    rows = read_table(spark, sf_dir, _TABLES[name])
    return spark.sql(text, rows=spread(rows, "p_partkey") if name in _WIDE else rows)


def with_views(sql: str) -> str:
    """The query with the model tables as DuckDB common table expressions."""
    views = ", ".join(f"{k} AS ({v.format(string='varchar', whole='bigint', hash='sha256(text)')})" for k, v in VIEWS.items()).replace("cast(floor(p_partkey / 10) as bigint)", "cast(cast(floor(p_partkey / 10) as bigint) as varchar)")
    rest = sql.strip()
    return f"WITH RECURSIVE {views}, {rest[5:]}" if rest[:5].upper() == "WITH " else f"WITH {views} {rest}"
