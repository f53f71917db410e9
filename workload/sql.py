"""DuckDB SQL texts for the scalar functions, written apart from the Spark expressions."""

SPACES = "[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


def norm(x: str) -> str:
    return f"lower(strip_accents(coalesce({x}, '')))"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({norm(x)}, '{SPACES}'), lambda t: t <> '')"


def slug(x: str) -> str:
    plain = f"lower(strip_accents(replace({x}, '''', ' ')))"
    return f"trim(regexp_replace({plain}, '[^a-z0-9]+', '-', 'g'), '-')"


def haversine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        f"(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)))))"
    )


def bearing(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        f"degrees(atan2(sin(radians({lng2} - {lng1})) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - "
        f"sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lng2} - {lng1}))))"
    )


def wrap(delta: str) -> str:
    return f"(CASE WHEN {delta} > 180 THEN {delta} - 360 WHEN {delta} < -180 THEN {delta} + 360 ELSE {delta} END)"


def turn_kind(d: str) -> str:
    side = f"CASE WHEN {d} > 0 THEN 'right' ELSE 'left' END"
    return (
        f"CASE WHEN abs({d}) < 25 THEN 'none' WHEN abs({d}) < 60 THEN 'slight-' || {side} "
        f"WHEN abs({d}) < 120 THEN {side} ELSE 'sharp-' || {side} END"
    )


def segment_dist(lat: str, lng: str, lat_a: str, lng_a: str, lat_b: str, lng_b: str) -> str:
    k = f"(111320.0 * cos(radians({lat})))"
    ax, ay = f"(({lng_a} - {lng}) * {k})", f"(({lat_a} - {lat}) * 111320.0)"
    dx, dy = f"(({lng_b} - {lng_a}) * {k})", f"(({lat_b} - {lat_a}) * 111320.0)"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(CASE WHEN {len2} > 0 THEN greatest(0.0, least(1.0, -({ax} * {dx} + {ay} * {dy}) / {len2})) ELSE 0.0 END)"
    return f"sqrt(pow({ax} + {t} * {dx}, 2) + pow({ay} + {t} * {dy}, 2))"


def with_utm(source: str, x: str = "x", y: str = "y") -> str:
    """source plus lat, lng by the inverse series, one step per nesting."""
    e2 = "(2 * 1 / 298.257222101 - pow(1 / 298.257222101, 2))"
    ep2 = f"({e2} / (1 - {e2}))"
    e1 = f"((1 - sqrt(1 - {e2})) / (1 + sqrt(1 - {e2})))"
    a = "6378137.0"
    mu = f"(({y}) / 0.9996 / ({a} * (1 - {e2} / 4 - 3 * pow({e2}, 2) / 64 - 5 * pow({e2}, 3) / 256)))"
    phi = (
        f"mu + (3 * {e1} / 2 - 27 * pow({e1}, 3) / 32) * sin(2 * mu) + (21 * pow({e1}, 2) / 16 - 55 * pow({e1}, 4) / 32) * sin(4 * mu)"
        f" + (151 * pow({e1}, 3) / 96) * sin(6 * mu) + (1097 * pow({e1}, 4) / 512) * sin(8 * mu)"
    )
    s1 = f"SELECT *, {mu} AS mu FROM {source}"
    s2 = f"SELECT *, {phi} AS phi FROM ({s1})"
    s3 = (
        f"SELECT *, {ep2} * pow(cos(phi), 2) AS c1, pow(tan(phi), 2) AS t1, {a} / sqrt(1 - {e2} * pow(sin(phi), 2)) AS n1,"
        f" {a} * (1 - {e2}) / pow(1 - {e2} * pow(sin(phi), 2), 1.5) AS r1 FROM ({s2})"
    )
    s4 = f"SELECT *, (({x}) - 500000.0) / (n1 * 0.9996) AS d FROM ({s3})"
    lat = (
        f"degrees(phi - (n1 * tan(phi) / r1) * (d * d / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * {ep2}) * pow(d, 4) / 24"
        f" + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * {ep2} - 3 * c1 * c1) * pow(d, 6) / 720))"
    )
    lng = (
        f"-3 + degrees((d - (1 + 2 * t1 + c1) * pow(d, 3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * {ep2} + 24 * t1 * t1)"
        f" * pow(d, 5) / 120) / cos(phi))"
    )
    return f"(SELECT * EXCLUDE (mu, phi, c1, t1, n1, r1, d), {lat} AS lat, {lng} AS lng FROM ({s4}))"


def ref_label(ref: str, label: str = "NULL") -> str:
    r = f"upper(trim({ref}))"
    pat = "'^\\d{5}[A-Z](\\d{3})(\\d{5})[0-9A-Z]*$'"
    return (
        f"CASE WHEN coalesce({r}, '') = '' THEN NULL WHEN regexp_matches({r}, {pat}) THEN 'Políg. ' || CAST(CAST(regexp_extract({r}, {pat}, 1) AS BIGINT) AS VARCHAR)"
        f" || ' · Parc. ' || CAST(CAST(regexp_extract({r}, {pat}, 2) AS BIGINT) AS VARCHAR) ELSE coalesce({label}, 'Ref. ' || {r}) END"
    )


def compact(ref: str) -> str:
    s = f"trim(coalesce({ref}, ''))"
    nums = f"regexp_extract_all({s}, '[0-9]+')"
    bare = f"trim(regexp_replace({s}, '^\\s*ref\\.?\\s*', '', 'i'))"
    return (
        f"CASE WHEN regexp_matches({s}, 'pol[ií]g', 'i') AND regexp_matches({s}, 'parc', 'i') AND len({nums}) >= 2"
        f" THEN {nums}[1] || '-' || {nums}[2] WHEN {bare} = '' THEN {s} ELSE {bare} END"
    )


def haystack(*columns: str) -> str:
    return norm(" || ' ' || ".join(f"coalesce({c}, '')" for c in columns))


def place_hay() -> str:
    return haystack("name", "partida", "num", "ref", compact("ref"), "address", "notes")
