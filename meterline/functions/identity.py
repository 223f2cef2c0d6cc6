"""Providers, credentials, callers, endpoints and the upstream grouping key."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions import text as X
from meterline.functions.text import tidy
from meterline.schema import (CHANNEL_PREFIX, EMPTY_CREDENTIAL, MASK, NAME_SEPARATOR, UNKNOWN_API,
                              UNKNOWN_ENDPOINT, UNKNOWN_MODEL, UNKNOWN_SOURCE)

# --- fixed values: provider spellings ------------------------------------------------------
OPENAI_NAMES = ["openai", "openai-response", "openai-responses"]
OPENAI_PREFIXES = ["openai-compatible", "openai-compatibility"]
CLAUDE_NAMES = ["anthropic", "claude"]
GEMINI_NAMES = ["gemini", "aistudio", "vertex", "google", "geminicli", "antigravity"]
GEMINI_PREFIXES = ["gemini-", "aistudio-", "vertex-", "geminicli-",
                   "antigravity-", "antigravity.", "antigravity_"]
FILE_PROVIDERS = {"claude": "claude", "anthropic": "claude", "kimi": "kimi", "xai": "xai", "grok": "xai",
                  "vertex": "vertex", "aistudio": "aistudio", "antigravity": "antigravity",
                  "gemini": "gemini", "geminicli": "gemini"}
OAUTH_PROVIDERS = ["claude", "codex", "kimi", "xai", "aistudio", "antigravity", "gemini", "vertex"]
KEY_SCHEMES = ["bearer", "token", "key", "apikey", "api-key"]
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
HASH_HEX_LENGTH = 56
# --- end of fixed values -------------------------------------------------------------------


def _starts(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


_OPENAI = "^(?:" + "|".join(OPENAI_NAMES) + ")$|^(?:" + "|".join(OPENAI_PREFIXES) + ")"
_CLAUDE = "^(?:" + "|".join(CLAUDE_NAMES) + ")(?:-|$)"
_GEMINI = "^(?:" + "|".join(GEMINI_NAMES) + ")$|^(?:" + "|".join(p.replace(".", "[.]") for p in GEMINI_PREFIXES) + ")"


def is_claude(provider: Column) -> Column:
    return F.lower(tidy(provider)).rlike(_CLAUDE)


def provider_family(provider: Column) -> Column:
    v = F.lower(tidy(provider))
    return (F.when(v.rlike(_OPENAI), F.lit("openai-compatible")).when(v.rlike(_CLAUDE), F.lit("claude"))
            .when(v.rlike(_GEMINI), F.lit("gemini")).otherwise(v))


def provider_from_auth(auth_id: Column) -> Column:
    v = tidy(auth_id)
    head = F.lower(tidy(F.substring_index(v, ":", 1)))
    second = tidy(F.get(F.split(v, ":"), F.lit(1)))
    file_name = F.regexp_extract(F.lower(v), r"([^/\\]*)$", 1)
    owner = F.regexp_extract(file_name, "^(" + "|".join(sorted(FILE_PROVIDERS, reverse=True)) + ")(?:$|[-_.:])", 1)
    by_file = F.lit("")
    for name, canonical in FILE_PROVIDERS.items():
        by_file = F.when(owner == name, F.lit(canonical)).otherwise(by_file)
    compat = head == "openai-compatibility"
    return (F.when(v == "", F.lit(""))
            .when(compat & ~v.contains(":"), F.lit("openai-compatible"))
            .when(compat & (second != ""), F.concat(F.lit("openai-compatible-"), second))
            .when((head == "codex") | F.lower(v).rlike("^codex[-_.]"), F.lit("codex"))
            .otherwise(by_file))


def auth_type_from_auth(auth_id: Column) -> Column:
    v = tidy(auth_id)
    head = F.lower(tidy(F.substring_index(v, ":", 1)))
    second = F.lower(tidy(F.get(F.split(v, ":"), F.lit(1))))
    return (F.when(head == "openai-compatibility", F.lit("apikey"))
            .when((head == "codex") & (second == "apikey"), F.lit("apikey"))
            .when(head == "codex", F.lit("oauth"))
            .when(provider_from_auth(auth_id).isin(OAUTH_PROVIDERS), F.lit("oauth"))
            .otherwise(F.lit("")))


def norm_model(model: Column) -> Column:
    return F.coalesce(F.nullif(tidy(model), F.lit("")), F.lit(UNKNOWN_MODEL))


_METHOD = "^(?i:" + "|".join(HTTP_METHODS) + r")\s+(\S+)"
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?+|//[^/?#]*)(/[^?#]*)"


def norm_endpoint(raw: Column) -> Column:
    """Reduce a route, path or URL to its path."""
    v = F.regexp_replace(tidy(raw), "(?s)" + _METHOD + ".*$", "$1")
    # only the path of a URL is percent-decoded; '+' stays itself
    path = F.try_url_decode(F.replace(F.regexp_extract(v, _URL, 1), F.lit("+"), F.lit("%2B")))
    cut = F.regexp_replace(v, "(?s)[?#].*$", "")
    v = F.rtrim(F.regexp_replace(tidy(F.coalesce(F.when(v.rlike(_URL), path), cut)), "^(?=[^/])", "/"), F.lit("/"))
    return F.regexp_replace(v, "^/responses$", "/v1/responses")


def infer_endpoint(raw: Column, *identities: Column) -> Column:
    known = norm_endpoint(raw)
    hint = F.lit(False)
    for c in identities:
        v = F.lower(F.coalesce(c, F.lit("")))
        hint = hint | (v.contains("openai") & v.contains("response"))
    return F.when(known != "", known).when(hint, F.lit("/v1/responses")).otherwise(F.lit(""))


def endpoint_label(endpoint: Column) -> Column:
    return F.coalesce(F.nullif(endpoint, F.lit("")), F.lit(UNKNOWN_ENDPOINT))


def source_key(source: Column) -> Column:
    return F.when(source == "", F.lit(UNKNOWN_SOURCE)).otherwise(source)


def summary_source(source: Column) -> Column:
    hidden = (source == "") | X.looks_private(tidy(source))
    return F.when(hidden, F.lit(UNKNOWN_SOURCE)).otherwise(source)


def credential_key(auth_index: Column) -> Column:
    return F.when(auth_index == "", F.lit(EMPTY_CREDENTIAL)).otherwise(auth_index)


def client_key_canonical(raw: Column) -> Column:
    v = F.btrim(tidy(raw), F.lit("\"'`"))
    schemes = "|".join(KEY_SCHEMES)
    two_words = rf"^\s*(?i:{schemes}):?\s+(\S+)\s*$"
    with_colon = rf"(?s)^(?i:{schemes}):(.*)$"
    inner = (F.when(v.rlike(two_words), F.regexp_extract(v, two_words, 1))
             .when(v.rlike(with_colon), tidy(F.regexp_extract(v, with_colon, 1))))
    return F.coalesce(F.btrim(inner, F.lit("\"'`")), v)


def client_key_hash(raw: Column, salt: str = "", bits: int = 224) -> Column:
    key = client_key_canonical(raw)
    return F.when(key == "", F.lit("")).otherwise(
        F.substring(F.sha2(F.concat(F.lit(salt + ":"), key), bits), 1, HASH_HEX_LENGTH))


def is_stored_hash(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{%d}$" % HASH_HEX_LENGTH), F.lit(False))


def is_short_mask(c: Column) -> Column:
    v = tidy(c)
    return v.endswith(MASK) & (F.length(v) == 1 + len(MASK))


def client_identity(api_key: Column, api_key_hash: Column, salt: str = "", bits: int = 224,
                    imported: bool = False) -> tuple[Column, Column]:
    """Repair (label, hash): raw keys are masked and hashed, masked keys keep a valid hash.

    For imported rows the hash survives only beside a one-character mask.
    """
    label = client_key_canonical(api_key)
    unknown = X.is_unknown_key(label)
    masked = label.contains(MASK)
    keep = is_stored_hash(tidy(api_key_hash))
    if imported:
        keep = keep & is_short_mask(label)
    new_label = F.when(unknown, F.lit("")).when(masked, label).otherwise(X.mask_key(label))
    new_hash = (F.when(unknown, F.lit(""))
                .when(masked, F.when(keep, tidy(api_key_hash)).otherwise(F.lit("")))
                .otherwise(client_key_hash(label, salt, bits)))
    return new_label, new_hash


def thinking_struct(effort: Column) -> Column:
    v = tidy(effort)
    level = F.nullif(v, F.lit(""))
    return F.struct(level.alias("intensity"), F.lit(None).cast("string").alias("mode"),
                    level.alias("level"), F.lit(None).cast("bigint").alias("budget"))


def _compatible(provider: Column) -> Column:
    return _starts(F.lower(tidy(provider)), OPENAI_PREFIXES)


def _generic(provider: Column) -> Column:
    return F.lower(tidy(provider)).isin(OPENAI_PREFIXES)


def join_names(*parts: Column) -> Column:
    """Distinct non-blank parts in order, joined by the name separator."""
    names = F.array_distinct(F.array(*[tidy(p) for p in parts]))
    return F.array_join(F.array_remove(names, ""), NAME_SEPARATOR)


def with_source_labels(df: DataFrame, *, imported: bool = False, out: str = "source_label") -> DataFrame:
    """Readable source; falls back to provider, executor and 'unknown' ('' for imports)."""
    df = df.withColumn("_s", X.strip_credential(F.col("source")))
    df = df.withColumn("_s", X.strip_own_key(F.col("_s"), F.col("api_key"), F.col("auth_index"), F.col("auth_id")))
    src, provider = F.col("_s"), tidy(F.col("provider"))
    hidden = (src == "") | X.looks_private(src)
    if imported:
        fallback = F.when((provider != "") & ~X.looks_private(provider), provider).otherwise(F.lit(""))
    else:
        fallback = X.strip_credential(X.first_text(provider, tidy(F.col("executor_type")), F.lit("unknown")))
    label = (F.when(_compatible(provider) & ~_generic(provider), provider)
             .when(~hidden, src).otherwise(fallback))
    return df.withColumn(out, label).drop("_s")


def with_upstream_key(df: DataFrame, out: str = "api") -> DataFrame:
    """Grouping key: provider with base URL, source or credential channel.

    Needs provider, executor_type, source, base_url, api_key, auth_index, auth_id.
    """
    # Stages keep each intermediate a column: inlined, the expression would grow with every reuse.
    c = F.col
    df = df.withColumns({
        "_primary": X.first_text(tidy(c("provider")), tidy(c("executor_type"))),
        "_base": tidy(c("base_url")),
        "_src": X.strip_credential(c("source")),
        "_id_index": X.credential_identity(c("auth_index")),
        "_id_source": X.credential_identity(c("source")),
        "_id_auth": X.credential_identity(c("auth_id")),
    })
    df = df.withColumns({
        "_open": ~_compatible(c("_primary")) | _generic(c("_primary")),
        "_src": X.strip_own_key(c("_src"), c("api_key"), c("auth_index"), c("auth_id")),
        "_in_source": X.credential_identity(c("_id_source")),
        "_in_auth": X.credential_identity(c("_id_auth")),
    })
    df = df.withColumns({
        "_n1": X.prefer(c("_id_index"), c("auth_index")), "_n2": X.prefer(c("_in_source"), c("_id_source")),
        "_n3": X.prefer(c("_in_auth"), c("_id_auth")), "_n4": X.prefer(c("_id_auth"), c("auth_id")),
    })
    df = df.withColumns({n: X.printable(c(n)) for n in ("_n1", "_n2", "_n3", "_n4")})
    df = df.withColumn("_ch", X.first_text(c("_n1"), c("_n2"), c("_n3"), c("_n4")))
    df = df.withColumn("_src", F.when(X.looks_credential(c("_src")), F.lit("")).otherwise(
        X.drop_leading(c("_src"), c("_primary"))))
    df = df.withColumn("_use_src", (c("_src") != "") & ~X.looks_secret(c("_src")) & c("_open")
                       & (c("_src") != c("_primary")))
    channel = F.when(~_compatible(c("_primary")) & ~c("_use_src") & (c("_ch") != ""),
                     F.concat(F.lit(CHANNEL_PREFIX), c("_ch")))
    named = F.when((c("_base") != "") & c("_open"), join_names(c("_primary"), c("_base"))).otherwise(
        join_names(c("_primary"), F.when(c("_use_src"), c("_src")), channel))
    return (df.withColumn(out, F.coalesce(F.nullif(named, F.lit("")), F.lit(UNKNOWN_API)))
            .drop("_primary", "_base", "_src", "_id_index", "_id_source", "_id_auth", "_open", "_ch", "_use_src",
                  "_in_source", "_in_auth", "_n1", "_n2", "_n3", "_n4"))


def with_imported_upstream_key(df: DataFrame, out: str = "api") -> DataFrame:
    """As ``with_upstream_key`` for history rows: the stored label stands in for the executor."""
    df = df.withColumn("_fb", X.strip_credential(F.col("api")))
    df = df.withColumn("_fb", tidy(X.strip_own_key(F.col("_fb"), F.col("api_key"), F.col("auth_index"),
                                                    F.col("auth_id"))))
    keep = df.withColumn("executor_type", F.col("_fb"))
    keyed = with_upstream_key(keep, "_key")
    known = (F.col("_key") != UNKNOWN_API) | (F.col("_fb") == "")
    return (keyed.withColumn(out, F.when(known, F.col("_key")).otherwise(F.col("_fb")))
            .drop("_fb", "_key", "executor_type"))
