"""Small SQL fragments shared by the DuckDB formulations."""

SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^[{SPACES}]+', ''), '[{SPACES}]+$', '')"


def squeeze(expr: str) -> str:
    return strip(f"regexp_replace({expr}, '[{SPACES}]+', ' ', 'g')")


def matches(text: str, pattern: str, keep: str, source: str) -> str:
    """Matches of an RE2 pattern with offsets: rows (keep..., span_start, span_end, span_text)."""
    return f"""
    SELECT {keep}, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS span_start,
           m[i] AS span_text, CAST(span_start + length(m[i]) AS BIGINT) AS span_end
    FROM (SELECT {keep}, regexp_split_to_array({text}, '{pattern}') AS g, regexp_extract_all({text}, '{pattern}') AS m,
                 unnest(range(1, len(m) + 1)) AS i FROM {source})"""
