"""Secret detection, masking and redaction of text columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterline.schema import MASK, NAME_SEPARATOR

# --- fixed values: what counts as a secret -------------------------------------------------
KEY_PREFIXES = ["sk-", "AIza", "hf_", "pk_", "rk_"]
AUTH_MARKERS = ["Authorization:", "authorization:", "Bearer ", "bearer ",
                "X-API-Key:", "x-api-key:", "Api-Key:", "api-key:"]
QUERY_PARAMS = ["key", "token", "api_key", "apikey"]
QUERY_ASSIGN = ["=", " %3D ", "%3D"]
UNKNOWN_KEYS = ["", "unknown", "(unknown)", "unknown api", "未知", "未知 api"]
UNKNOWN_KEY_PREFIX = "未"
CREDENTIAL_MARKERS = ["apikey", "key", "credential", "auth"]
SEPARATORS = [" · ", " - ", " | ", "/"]
SENSITIVE_HEADERS = ["authorization", "proxy-authorization", "cookie", "set-cookie",
                     "x-api-key", "x-auth-token", "x-access-token", "api-key"]
# --- end of fixed values -------------------------------------------------------------------

SPACES = " \t\n\r\u000b\u000c\u0085   　"
_TOKEN = "[A-Za-z0-9_-]"
_PART = "\u0001"  # stands for whichever separator a label uses

# Lengths count bytes, so the patterns run over one character per byte.
_SECRET = "^(?:" + "|".join(KEY_PREFIXES) + ")|^[^ /._-]{40,}$|^[^ ]{80,}$"
_CREDENTIAL = "^[0-9a-fA-F]{8,}$|^[^ /._-]{32,}$"

# A marker may carry '-' and '_' between its letters and blanks around it.
_MARKER = r"[-_\s]*(?i:" + "|".join("[-_]*".join(m) for m in CREDENTIAL_MARKERS) + r")[-_\s]*"


def tidy(c: Column) -> Column:
    """Trim every kind of white space; NULL becomes ''."""
    return F.coalesce(F.btrim(c, F.lit(SPACES)), F.lit(""))


def first_text(*cols: Column) -> Column:
    """First value that is not blank, else ''."""
    return F.coalesce(*[F.when(tidy(c) != "", c) for c in cols], F.lit(""))


def _bytes(s: Column) -> Column:
    return F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")


def looks_secret(c: Column) -> Column:
    return F.coalesce(_bytes(tidy(c)).rlike(_SECRET), F.lit(False))


def _hyphenated_hex(s: Column) -> Column:
    """At least 30 characters without the hyphens, four fifths of them (or 30) hexadecimal."""
    solid = F.octet_length(F.replace(s, F.lit("-"), F.lit("")))
    hexes = F.length(F.regexp_replace(s, "[^0-9a-fA-F]", ""))
    return s.contains("-") & (solid >= 30) & ((hexes >= 30) | (hexes * 5 >= solid * 4))


def looks_credential(c: Column) -> Column:
    s = tidy(c)
    return F.coalesce(_bytes(s).rlike(_CREDENTIAL), F.lit(False)) | _hyphenated_hex(s)


def looks_private(s: Column) -> Column:
    """Secret or credential; ``s`` is trimmed."""
    return F.coalesce(_bytes(s).rlike(_SECRET + "|" + _CREDENTIAL), F.lit(False)) | _hyphenated_hex(s)


def mask_token(c: Column) -> Column:
    """Keep two characters at each end."""
    return (F.when(F.octet_length(c) <= 4, F.lit(MASK))
            .otherwise(F.concat(F.substring(c, 1, 2), F.lit(MASK), F.right(c, F.lit(2)))))


def is_unknown_key(c: Column) -> Column:
    v = F.lower(tidy(c))
    return v.isin(UNKNOWN_KEYS) | (v.startswith(UNKNOWN_KEY_PREFIX) & v.endswith(MASK))


def mask_key(c: Column) -> Column:
    """First character and the marker; nothing for unknown spellings."""
    return F.when(is_unknown_key(c), F.lit("")).otherwise(
        F.concat(F.substring(tidy(c), 1, 1), F.lit(MASK)))


def name_parts(value: Column) -> Column:
    """The value with its separator (the first kind it contains) replaced by the part mark."""
    out = value
    for sep in reversed(SEPARATORS):
        out = F.when(value.contains(sep), F.replace(value, F.lit(sep), F.lit(_PART))).otherwise(out)
    return out


def _rejoin(parts: Column) -> Column:
    return F.replace(parts, F.lit(_PART), F.lit(NAME_SEPARATOR))


def last_part(c: Column, sep: str) -> Column:
    return F.substring_index(c, sep, -1)


def without_last(c: Column, sep: str) -> Column:
    return F.regexp_extract(c, "(?s)^(.*)" + sep, 1)


def strip_credential(c: Column) -> Column:
    """Cut a trailing credential from a label."""
    v = tidy(c)
    p = name_parts(v)
    at_marker = f"(?s)^(.*?){_PART}{_MARKER}(?:{_PART}.*)?$"
    return (F.when(p.rlike(at_marker), _rejoin(F.regexp_extract(p, at_marker, 1)))
            .when(p.contains(_PART) & looks_private(tidy(last_part(p, _PART))), _rejoin(without_last(p, _PART)))
            .when(v.rlike("(?s):.*:") & looks_credential(last_part(v, ":")), without_last(v, ":"))
            .otherwise(v))


def strip_own_key(label: Column, api_key: Column, auth_index: Column, auth_id: Column) -> Column:
    """``label`` is already stripped; also drop the caller key itself unless it is the credential."""
    key = tidy(api_key)
    foreign = (key != tidy(auth_index)) & (key != tidy(auth_id))
    p = name_parts(label)
    return (F.when((label == "") | (key == "") | ~foreign, label)
            .when(label == key, F.lit(""))
            .when(p.contains(_PART) & (tidy(last_part(p, _PART)) == key), _rejoin(without_last(p, _PART)))
            .otherwise(label))


def drop_leading(value: Column, leading: Column) -> Column:
    """Remove the first name part where it repeats ``leading``."""
    p = name_parts(value)
    repeats = p.contains(_PART) & (leading != "") & (tidy(F.substring_index(p, _PART, 1)) == leading)
    return F.when(repeats, _rejoin(F.regexp_extract(p, f"(?s)^.*?{_PART}(.*)$", 1))).otherwise(value)


def credential_identity(c: Column) -> Column:
    """The part of a label that names the credential, '' where there is none."""
    v = tidy(c)
    p = name_parts(v)
    after_marker = f"(?s)^(?:.*?{_PART})??{_MARKER}{_PART}(.*)$"
    after_colon = f"(?s)^(?:.*?:)??{_MARKER}:(.*)$"
    tail = last_part(p, _PART)
    return (F.when(p.rlike(after_marker), _rejoin(F.regexp_extract(p, after_marker, 1)))
            .when(p.contains(_PART) & looks_private(tidy(tail)), tail)
            .when(v.rlike(after_colon), F.regexp_extract(v, after_colon, 1))
            .when(v.rlike("(?s):.*:") & looks_credential(last_part(v, ":")), last_part(v, ":"))
            .otherwise(F.lit("")))


def prefer(inner: Column, outer: Column) -> Column:
    """The nested identity where there is one."""
    return F.when(tidy(inner) != "", tidy(inner)).otherwise(tidy(outer))


def printable(name: Column) -> Column:
    """Key-like names are masked."""
    return F.when(looks_secret(name), mask_token(name)).otherwise(name)


def redact_text(c: Column) -> Column:
    """Mask keys with known prefixes, authorisation values and key-like query parameters."""
    out = F.coalesce(c, F.lit(""))
    for prefix in KEY_PREFIXES:
        head, need = prefix[:2], len(prefix) - 2
        # the prefix itself counts towards the two visible characters at the end
        long_token = f"{prefix[:3]}(?={prefix[3:]}){_TOKEN}*({_TOKEN}{{2}})" if len(prefix) > 3 \
            else f"{prefix}{_TOKEN}*({_TOKEN}{{2}})"
        out = F.regexp_replace(out, long_token, f"{head}{MASK}$1")
        out = F.regexp_replace(out, f"{prefix}{_TOKEN}*", MASK)
    markers = "|".join(AUTH_MARKERS)
    out = F.regexp_replace(
        out, f"((?:{markers})[ \\t]*)([^ ,\\n\\r;]{{2}})[^ ,\\n\\r;]{{28,}}([^ ,\\n\\r;]{{2}})", f"$1$2{MASK}$3")
    assign = "(?:" + "|".join(QUERY_PARAMS) + ")(?:" + "|".join(QUERY_ASSIGN) + ")"
    return F.regexp_replace(out, f"({assign})([^ &;\\n\\r])[^ &;\\n\\r]{{31,}}", f"$1$2{MASK}")


def sanitize_text(c: Column) -> Column:
    """Redaction plus shortening of older two-character masks."""
    return F.regexp_replace(redact_text(c), f"({_TOKEN}){_TOKEN}\\*{{6}}{_TOKEN}{{2}}", f"$1{MASK}")


def shorten(c: Column, limit: int) -> Column:
    v = tidy(c)
    return F.when(F.length(v) <= limit, v).otherwise(F.concat(F.substring(v, 1, limit), F.lit("...")))


def allowed_header(name: Column, allow: str) -> Column:
    """Allow-list test for one header name; sensitive names never pass."""
    entries = [e.strip().lower() for e in allow.split(",") if e.strip()]
    exact = [e for e in entries if not e.endswith("*")]
    heads = [e[:-1].strip() for e in entries if e.endswith("*") and e[:-1].strip()]
    n = F.lower(tidy(name))
    ok = F.lit("*" in entries) | n.isin(exact) if exact else F.lit("*" in entries)
    for h in heads:
        ok = ok | n.startswith(h)
    return (n != "") & ~n.isin(SENSITIVE_HEADERS) & ok


def headers_filter(headers: Column, allow: str) -> Column:
    return F.map_filter(headers, lambda k, v: allowed_header(k, allow))
