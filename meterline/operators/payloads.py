"""Usage out of captured response bodies, and settled stream chunks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.identity import provider_family
from meterline.functions.text import tidy

# --- fixed values: field names after lower-casing and dropping '_' and '-' ------------------
USAGE_NAMES = ["usage", "totalusage", "usagemetadata"]
ID_NAMES = ["id", "responseid", "requestid", "streamid"]
INPUT_NAMES = ["prompttokens", "inputtokens", "totalinputtokens", "prompttokencount"]
OUTPUT_NAMES = ["completiontokens", "outputtokens", "totaloutputtokens", "candidatestokencount"]
REASONING_NAMES = ["reasoningtokens", "totalthoughttokens", "thoughtstokencount"]
CACHED_NAMES = ["cachedtokens", "totalcachedtokens", "cachedcontenttokencount"]
CACHE_READ_NAMES = ["cachereadtokens", "cachereadinputtokens"]
CACHE_CREATION_NAMES = ["cachecreationtokens", "cachecreationinputtokens", "cachewritetokens"]
TOTAL_NAMES = ["totaltokens", "totaltokencount"]
NESTED_NAMES = ["prompttokensdetails", "inputtokensdetails", "completiontokensdetails", "cacheusage"]
NESTED_CACHED = ["cachedtokens"]
NESTED_CREATION = ["cachecreationtokens", "cachewritetokens"]
DONE = "[DONE]"
# --- end of fixed values -------------------------------------------------------------------

USAGE = ["input_tokens", "output_tokens", "reasoning_tokens", "cached_tokens", "cache_read_tokens",
         "cache_creation_tokens", "total_tokens"]
MAX_DEPTH = 32

#: Names that fill a counter: those of the usage object, and those of its nested objects.
_FILLED_BY = {
    "input_tokens": (INPUT_NAMES, []), "output_tokens": (OUTPUT_NAMES, []), "reasoning_tokens": (REASONING_NAMES, []),
    "cached_tokens": (CACHED_NAMES, NESTED_CACHED), "cache_read_tokens": (CACHE_READ_NAMES + CACHED_NAMES, NESTED_CACHED),
    "cache_creation_tokens": (CACHE_CREATION_NAMES, NESTED_CREATION), "total_tokens": (TOTAL_NAMES, [])}
_MAP, _LIST = "map<string,variant>", "array<variant>"
_NODES = "array<struct<told:boolean,v:variant>>"
_FIELDS = "array<struct<told:boolean,name:string,v:variant>>"


def _one_of(column: str, names: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(n) for n in names)})"


def _plain(key: str) -> str:
    return f"translate(lower(trim({key})), '_-', '')"


def _fields(v: str, told: str = "false") -> str:
    """The fields of an object, by name; none of anything else."""
    return (f"transform(map_entries(coalesce(try_variant_get({v}, '$', '{_MAP}'), CAST(map() AS {_MAP}))), "
            f"e -> named_struct('told', {told}, 'name', {_plain('e.key')}, 'v', e.value))")


def _whole(v: str) -> str:
    """A counter: whole numbers in text count, other text is 0, fractions of numbers are cut."""
    number = "coalesce(CAST(least(greatest(try_cast(t AS double), -9.2233720368547e18D), 9.2233720368547e18D) AS bigint), 0)"
    value = (f"CASE WHEN t RLIKE '^[+-]?[0-9]{{1,19}}$' THEN coalesce(try_cast(t AS bigint), 0) "
             f"WHEN schema_of_variant({v}) = 'STRING' THEN 0 ELSE {number} END")
    return _named(f"trim(try_variant_get({v}, '$', 'string'))", "t", value)


def _step() -> str:
    """One level down: the fields of all open objects, and what is inside messages, responses and arrays."""
    wanted = USAGE_NAMES + ID_NAMES + ["model"]
    fields = f"flatten(transform(acc.open, n -> {_fields('n.v', 'n.told')}))"
    items = (f"flatten(transform(acc.open, n -> transform(coalesce(try_variant_get(n.v, '$', '{_LIST}'), CAST(array() AS {_LIST})), "
             "x -> named_struct('told', n.told, 'v', x))))")
    inside = "transform(filter(fs, f -> f.name IN ('message', 'response')), f -> named_struct('told', f.told OR f.name = 'message', 'v', f.v))"
    found = f"filter(fs, f -> {_one_of('f.name', wanted)})"
    down = (f"named_struct('open', CAST(concat({items}, {inside}) AS {_NODES}), "
            f"'found', CAST(concat(acc.found, {found}) AS {_FIELDS}))")
    return f"CASE WHEN size(acc.open) = 0 THEN acc ELSE {_named(fields, 'fs', down)} END"


def _named(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _counters(usage: str) -> str:
    """The counters of a usage object: of the names that fill one, the first that is not 0."""
    nested = f"flatten(transform(filter(u, f -> {_one_of('f.name', NESTED_NAMES)}), f -> {_fields('f.v')}))"

    def first(names: list[str], inner: list[str]) -> str:
        own = f"filter(u, f -> {_one_of('f.name', names)})"
        both = f"concat({own}, filter(n, f -> {_one_of('f.name', inner)}))" if inner else own
        return f"coalesce(get(filter(transform({both}, f -> {_whole('f.v')}), x -> x <> 0), 0), 0)"

    parts = ", ".join(f"'{c}', {first(*names)}" for c, names in _FILLED_BY.items() if c != "total_tokens")
    total = first(*_FILLED_BY["total_tokens"])
    all_ = ", ".join(f"'{c}', c.{c}" for c in USAGE[:-1])
    whole = f"named_struct({all_}, 'total_tokens', CASE WHEN c.t <> 0 THEN c.t ELSE c.input_tokens + c.output_tokens END)"
    return _named(_fields(usage), "u", _named(nested, "n", _named(f"named_struct({parts}, 't', {total})", "c", whole)))


_WEIGHT = " + ".join(f"abs(c.{n})" for n in USAGE)


def _documents(text: Column) -> Column:
    """The JSON documents of a body: itself, or its event-stream data lines."""
    body = F.trim(text, F.lit(" \t\r\n"))
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30), F.lit(" \t")))
    return F.when(body.rlike(r"^[{\[]"), F.array(body)).otherwise(F.filter(data, lambda d: (d != "") & (d != DONE)))


def decode_payload_usage(bodies: DataFrame, stream_mode: Column, body: str = "body") -> DataFrame:
    """Adds the usage of each body: the fullest usage object at any depth, with the model and id of its own document.

    Bodies are parsed to VARIANT values and searched level by level with built-in functions: no schema, no shuffle and
    no Python. Among equal usages the later document wins, inside a document the deeper and then the later name;
    the first model and id are the shallowest. A document with a name twice in one object, or with a model that is no
    text, is unreadable. Rows without usage are dropped; null bodies have none.
    """
    c = F.col
    text = c(body)
    may = F.lower(F.translate(text, "_-", "")).contains("usage") | text.contains("\\u")
    parsed = "filter(transform(__docs, d -> try_parse_json(d)), v -> v IS NOT NULL)"
    start = f"named_struct('open', CAST(array(named_struct('told', false, 'v', v)) AS {_NODES}), 'found', CAST(array() AS {_FIELDS}))"
    found = f"transform({parsed}, v -> aggregate(sequence(0, {MAX_DEPTH}), {start}, (acc, i) -> {_step()}, acc -> acc.found))"
    usages = f"transform(filter(fs, f -> {_one_of('f.name', USAGE_NAMES)} AND NOT (__stream AND f.told)), f -> {_counters('f.v')})"
    best = f"array_max(transform({usages}, (c, i) -> named_struct('weight', {_WEIGHT}, 'at', i, 'c', c)))"
    models = "filter(fs, f -> f.name = 'model' AND NOT is_variant_null(f.v))"
    model = f"coalesce(get(filter(transform({models}, f -> try_variant_get(f.v, '$', 'string')), x -> x <> ''), 0), '')"
    ids = (f"filter(fs, f -> {_one_of('f.name', ID_NAMES)} AND NOT is_variant_null(f.v) AND NOT schema_of_variant(f.v) RLIKE '^(OBJECT|ARRAY)')")
    ident = f"coalesce(get(filter(transform({ids}, f -> try_variant_get(f.v, '$', 'string')), x -> x <> ''), 0), '')"
    readable = f"filter(__found, fs -> NOT exists({models}, f -> schema_of_variant(f.v) <> 'STRING'))"
    told = f"transform({readable}, (fs, d) -> named_struct('b', {best}, 'doc', d, 'model', {model}, 'id', {ident}))"
    winner = ("array_max(transform(filter(__told, t -> t.b.weight > 0), "
              "t -> named_struct('weight', t.b.weight, 'doc', t.doc, 'model', t.model, 'id', t.id, 'c', t.b.c)))")
    rows = bodies.withColumns({"__stream": F.coalesce(stream_mode, F.lit(False)), "__docs": F.when(may, _documents(text))})
    # one expression inside a generator: as columns and a filter the search would be repeated for each use
    chosen = _named(f"{found}", "__found", _named(told, "__told", f"filter(array({winner}), w -> w IS NOT NULL)"))
    won = rows.withColumn("__won", F.explode(F.expr(chosen)))
    return won.select(*bodies.columns, c("__won.model").alias("decoded_model"), c("__won.id").alias("decoded_id"), *[c("__won.c")[n].alias(n) for n in USAGE])


def stream_key() -> list[Column]:
    """Identity of one response stream."""
    from meterline.functions.text import is_unknown_key
    from meterline.functions.identity import client_key_canonical
    key = client_key_canonical(F.col("api_key"))
    return [provider_family(F.col("provider")).alias("family"), F.lower(tidy(F.col("auth_id"))).alias("auth"),
            F.when(is_unknown_key(key), F.lit("")).otherwise(key).alias("caller"),
            tidy(F.col("correlation_id")).alias("correlation")]


def settle_stream(chunks: DataFrame) -> DataFrame:
    """Per stream the usage of its highest chunk that has any; later arrival wins ties.

    Chunks without a correlation id belong to no stream and count one by one.
    """
    names = ["family", "auth", "caller", "correlation"]
    rows = chunks.where("input_tokens <> 0 or output_tokens <> 0").select(
        *stream_key(), "chunk_index", "seq", "input_tokens", "output_tokens")
    alone = F.coalesce(F.col("correlation") == "", F.lit(True))
    best = F.max_by(F.struct("chunk_index", "input_tokens", "output_tokens"), F.struct("chunk_index", "seq"))
    settled = rows.where(~alone).groupBy(*names).agg(best.alias("b")).select(*names, "b.*")
    return settled.unionByName(rows.where(alone).select(*settled.columns))
