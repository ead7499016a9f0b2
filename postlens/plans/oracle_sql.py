"""The queries of the catalogue as SQL over the given tables, for checking results.

Written for DuckDB, independently of the DataFrame code; only the fixed values
(word lists, patterns, bounds) and the fixture fragments are shared.
"""

from __future__ import annotations

from ..functions import fixed_values as fv
from ..functions.extract import FIELDS
from ..sources import fixture
from .catalogue import COMMAND_ARGS, FAILING, FILTERS, HREF_NEEDLES, SHORT_VALUES, SHOWN, STORED_BEFORE


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains({col}, {_q(n)})" for n in needles) + ")"


def _has(pattern: str, col: str = "t") -> str:
    return f"regexp_matches({col}, {_q(pattern)})"


def _first(pattern: str, group: int = 1, col: str = "t") -> str:
    return f"nullif(regexp_extract({col}, {_q(pattern)}, {group}), '')"


def _number(pattern: str) -> str:
    return f"TRY_CAST(replace({_first(pattern)}, ',', '') AS HUGEINT)"


def _bounded(value: str, bounds) -> str:
    return f"CASE WHEN {value} BETWEEN {bounds[0]} AND {bounds[1]} THEN {value} END"


def _list(fragments) -> str:
    return "[" + ", ".join(_q(f or "") for f in fragments) + "]"


def _initcap(value: str) -> str:
    return f"(upper(substr({value}, 1, 1)) || substr({value}, 2))"


# ------------------------------------------------------------------ fixture


def _posts() -> str:
    parts = []
    for fragments in fixture.LISTS:
        pick = f"{_list(fragments)}[1 + k % {len(fragments)}]"
        if fragments is fixture.RENT:
            pick = f"replace({pick}, '{{N}}', CAST(5000 + 500 * (k % 40) AS VARCHAR))"
        parts.append(pick)
    parts.append(
        "CASE WHEN k % 5 = 4 THEN '' ELSE '. Contact: ' || "
        f"{_list(fixture.PHONE_PREFIX)}[1 + k % 3] || '9' || lpad(CAST(k AS VARCHAR), 9, '0') END"
    )
    parts.append(f"CASE WHEN o_orderkey % 8 = 7 THEN {_q(fixture.REPOST)} ELSE '' END")
    return f"""keyed AS (
  SELECT *, CASE o_orderkey % 8 WHEN 3 THEN o_orderkey - 1 WHEN 7 THEN o_orderkey - 3
            ELSE o_orderkey END AS k
  FROM orders),
posts AS (
  SELECT o_orderkey AS post_id, o_custkey % 16 AS group_id, o_orderdate AS scraped_at,
         {" || ".join(parts)} AS text,
         CASE o_orderkey % 4
           WHEN 1 THEN 'https://img.example/' || o_orderkey || '/a.jpg'
           WHEN 2 THEN 'https://img.example/' || o_orderkey || '/a.jpg|https://img.example/' || o_orderkey || '/b.jpg'
         END AS images,
         CASE WHEN o_orderkey % 3 <> 0
           THEN 'https://groups.example/' || (o_custkey % 16) || '/posts/' || o_orderkey END AS post_url
  FROM keyed)"""


# ------------------------------------------------------------------ extraction


def _captured(source: str, key: str) -> str:
    """CTE ``captured``: one column per number or span the rules read."""
    columns = [f"{_number(p)} AS n{i}" for i, p in enumerate(fv.RENT, 1)]
    columns += [
        f"{_number(fv.RENT_SPAN)} * 1000 AS span_low",
        f"{_number(fv.DEPOSIT[0])} AS d1",
        f"{_number(fv.DEPOSIT[1])} AS d2",
        f"{_number(fv.SQFT)} AS sq",
        f"{_number(fv.MAINTENANCE)} AS mt",
        *[f"{_first(p, g)} AS {n}" for n, p, g in (
            ("dm1", fv.DAY_MONTH, 1), ("dm2", fv.DAY_MONTH, 2), ("md1", fv.MONTH_DAY, 1),
            ("md2", fv.MONTH_DAY, 2), ("wk1", fv.WEEK_OF_MONTH, 1), ("wk2", fv.WEEK_OF_MONTH, 2))],
    ]
    return f"""normal AS (SELECT *, {key} AS row_id, lower(text) AS t FROM {source}),
captured AS (SELECT *, {", ".join(columns)} FROM normal)"""


def _fields() -> str:
    steps = [
        f"CASE WHEN n{i} < 100 THEN n{i} * 1000 WHEN n{i} BETWEEN 1000 AND 500000 THEN n{i} END"
        for i in range(1, 9)
    ]
    areas = ", ".join(f"CASE WHEN contains(t, {_q(a)}) THEN {_q(a.title())} END" for a in fv.AREAS)
    amenities = ", ".join(f"CASE WHEN {_has(p)} THEN {_q(a)} END" for a, p in fv.AMENITIES)
    furnished = " ".join(f"WHEN {_has(p)} THEN {_q(v)}" for p, v in fv.FURNISHED)
    present = "list_filter([{}], lambda v: v IS NOT NULL)"
    columns = {
        "bhk": f"CASE WHEN {_has(fv.RK)} THEN 'RK' ELSE {_first(fv.BHK)} END",
        "rent": f"coalesce({', '.join(steps)}, {_bounded('span_low', fv.RENT_BOUNDS)})",
        "deposit": f"coalesce({_bounded('d1', fv.DEPOSIT_BOUNDS)}, {_bounded('d2', fv.DEPOSIT_BOUNDS)})",
        "sqft": _bounded("sq", fv.SQFT_BOUNDS),
        "location": f"nullif(array_to_string(({present.format(areas)})[1:3], ', '), '')",
        "gated_community": "(" + " OR ".join(_has(p) for p in fv.GATED) + ")",
        "furnished": f"CASE {furnished} END",
        "available_from": f"""CASE WHEN {_has(fv.AVAILABLE_NOW)} THEN 'immediate'
            WHEN dm1 IS NOT NULL THEN dm1 || ' ' || {_initcap('dm2')}
            WHEN md2 IS NOT NULL THEN md2 || ' ' || {_initcap('md1')}
            WHEN wk1 IS NOT NULL THEN 'Week ' || wk1 || ' of ' || {_initcap('wk2')} END""",
        "floor": _first(fv.FLOOR),
        "maintenance": _bounded("mt", fv.MAINTENANCE_BOUNDS),
        "parking": f"""CASE WHEN {_has(fv.CAR_PARKING)} AND {_has(fv.BIKE_PARKING)} THEN 'both'
            WHEN {_has(fv.CAR_PARKING)} THEN 'car' WHEN {_has(fv.BIKE_PARKING)} THEN 'bike'
            WHEN contains(t, 'parking') THEN 'car' END""",
        "facing": _first(fv.FACING),
        "lease_duration": f"CAST(coalesce({_first(fv.LEASE[0])}, {_first(fv.LEASE[1])}) AS BIGINT)",
        "amenities": f"nullif(array_to_string({present.format(amenities)}, '|'), '')",
        "contact": _first(fv.CONTACT, col="text"),
    }
    selected = ",\n  ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"""fields AS (SELECT * EXCLUDE (t, n1, n2, n3, n4, n5, n6, n7, n8, span_low, d1, d2, sq, mt,
  dm1, dm2, md1, md2, wk1, wk2),
  {selected} FROM captured)"""


NUMBERS = ("rent", "deposit", "sqft", "maintenance", "lease_duration")


def _out(name: str) -> str:
    """A column in the portable output type."""
    if name in NUMBERS:
        return f"CAST({name} AS BIGINT) AS {name}"
    if name in ("gated_community", "no_brokerage"):
        return f"CAST(CAST({name} AS INT) AS BIGINT) AS {name}"
    if name in ("created_at", "scraped_at", "saved_at"):
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"
    return name


def _outs(names) -> str:
    return ", ".join(map(_out, names))


# ------------------------------------------------------------------ enrichment


def _norm_furnished(v: str) -> str:
    v = f"lower(trim({v}))"
    return (
        f"CASE WHEN contains({v}, 'unfurnish') THEN 'unfurnished' WHEN contains({v}, 'semi') THEN 'semi' "
        f"WHEN contains({v}, 'full') OR {v} = 'furnished' THEN 'fully' END"
    )


def _norm_parking(v: str) -> str:
    v = f"lower(trim({v}))"
    both, bike = ", ".join(map(_q, fv.PARKING_BOTH)), ", ".join(map(_q, fv.PARKING_BIKE))
    return (
        f"CASE WHEN {v} IN ({both}) THEN 'both' WHEN contains({v}, 'car') THEN 'car' "
        f"WHEN {v} IN ({bike}) THEN 'bike' END"
    )


def _norm_bhk(v: str) -> str:
    v = f"upper(trim({v}))"
    return f"CASE WHEN {v} = 'RK' THEN 'RK' ELSE {_first(fv.BHK_IN_TEXT, col=v)} END"


def _norm_rent_text(v: str) -> str:
    n = f"TRY_CAST({_first(fv.RENT_IN_TEXT, col=v)} AS BIGINT)"
    return _bounded(n, fv.RENT_BOUNDS)


def _classes(low: str) -> dict[str, str]:
    veg, non_veg = _any(low, fv.VEG_SIGNALS), _any(low, fv.NON_VEG_SIGNALS)
    return {
        "listing_type": f"""CASE WHEN {_any(low, fv.FLATMATE_SIGNALS)} THEN 'flatmate'
            WHEN {_any(low, fv.ROOM_SIGNALS)} THEN 'room' ELSE 'full_flat' END""",
        "food_preference": f"""CASE WHEN {veg} AND NOT {non_veg} THEN 'veg'
            WHEN {non_veg} AND NOT {veg} THEN 'non_veg' WHEN {veg} AND {non_veg} THEN 'any' END""",
        "gender_preference": f"""CASE WHEN {_any(low, fv.FEMALE_SIGNALS)} THEN 'female'
            WHEN {_any(low, fv.MALE_SIGNALS)} THEN 'male' ELSE 'any' END""",
        "no_brokerage": _any(low, fv.NO_BROKERAGE_SIGNALS),
    }


def _listings(source: str = "fields", name: str = "listings") -> str:
    classes = ", ".join(f"{sql} AS {c}" for c, sql in _classes("lower(text)").items())
    return f"""{name} AS (SELECT * REPLACE (
    {_norm_furnished('furnished')} AS furnished, {_norm_parking('parking')} AS parking,
    {_bounded('rent', fv.RENT_BOUNDS)} AS rent, {_norm_bhk('bhk')} AS bhk),
  post_id AS id, text AS raw_text, scraped_at AS created_at, {classes} FROM {source})"""


def _sql(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([_posts(), _captured("posts", "post_id"), _fields(), _listings(), *ctes]) + "\n" + select


# ------------------------------------------------------------------ predictions


def _decoded() -> str:
    output = f"{_list(fixture.MODEL_OUTPUT)}[1 + post_id % 8]"

    def kind(f: str) -> str:
        return f"json_type(o, '$.{f}')"

    def string(f: str) -> str:
        return f"json_extract_string(o, '$.{f}')"

    def text(f: str) -> str:
        return (
            f"CASE WHEN {kind(f)} = 'VARCHAR' THEN {string(f)} WHEN {kind(f)} IN ('BIGINT', 'UBIGINT', 'DOUBLE') "
            f"AND TRY_CAST({string(f)} AS DOUBLE) <> 0 THEN {string(f)} END"
        )

    labels = ", ".join(_q(a) for a, _ in fv.AMENITIES)
    columns = [f"{text(f)} AS model_{f}" for f in ("bhk", "location", "available_from", "floor", "parking", "facing")]
    columns += [f"TRY_CAST({string(f)} AS BIGINT) AS model_{f}" for f in ("deposit", "sqft", "maintenance", "lease_duration")]
    columns += [
        f"""CASE WHEN {kind('rent')} = 'VARCHAR' THEN {_norm_rent_text(string('rent'))}
            WHEN {kind('rent')} IN ('BIGINT', 'UBIGINT') THEN {_bounded(f"CAST({string('rent')} AS BIGINT)", fv.RENT_BOUNDS)} END
            AS model_rent""",
        f"CASE WHEN {kind('furnished')} = 'VARCHAR' THEN {string('furnished')} END AS model_furnished",
        f"CASE WHEN {kind('gated_community')} = 'BOOLEAN' THEN {string('gated_community')} = 'true' END AS model_gated_community",
        f"""nullif(array_to_string(list_filter(CAST(json_extract(o, '$.amenities') AS VARCHAR[]),
            lambda a: lower(a) IN ({labels})), '|'), '') AS model_amenities""",
        "(o IS NULL OR CAST(o AS VARCHAR) = '{}') AS model_empty",
    ]
    return f"""answers AS (
  SELECT post_id, regexp_extract({output}, {_q("(?s)" + fv.MODEL_JSON_FIRST)}) AS j FROM posts WHERE post_id % 8 <> 0),
objects AS (SELECT post_id, CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS o FROM answers),
decoded AS (SELECT post_id, {", ".join(columns)} FROM objects)"""


def _merged() -> str:
    def number(f: str) -> str:
        return f"coalesce(nullif({f}, 0), nullif(model_{f}, 0))"

    date = f"""CASE WHEN NOT (length(model_available_from) = 10 AND substr(model_available_from, 5, 1) = '-')
        AND {_any('lower(model_available_from)', (*fv.MONTH_ABBREVIATIONS, 'immedia'))} THEN model_available_from END"""
    columns = [f"coalesce({f}, model_{f}) AS {f}" for f in ("bhk", "floor", "parking", "facing", "amenities")]
    columns += [f"{number(f)} AS {f}" for f in NUMBERS]
    columns += [
        f"coalesce(available_from, {date}) AS available_from",
        "coalesce(model_location, location) AS location",
        "gated_community OR coalesce(model_gated_community, FALSE) AS gated_community",
        "coalesce(nullif(model_furnished, ''), furnished) AS furnished",
    ]
    return f"""merged AS (SELECT * EXCLUDE (model_empty) REPLACE ({", ".join(columns)})
  FROM fields LEFT JOIN decoded USING (post_id))"""


# ------------------------------------------------------------------ admission


def _admitted(source: str, name: str) -> str:
    return f"""{name} AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {_entry()} ORDER BY id) = 1)"""


def _entry() -> str:
    return """CASE WHEN contact <> '' AND bhk <> '' AND location IS NOT NULL
      THEN 'K|' || contact || '|' || bhk || '|' || location ELSE 'T|' || raw_text END"""


def _rounds(source: str) -> str:
    """Two-key admission in rounds: state 0 waits, 1 has entered, 2 has not.

    A row enters when no earlier row that may still enter shares its text or its triple."""
    return f"""admission_keys AS MATERIALIZED (
  SELECT id, 'T' || raw_text AS text_key, CASE WHEN contact <> '' AND bhk <> '' AND location IS NOT NULL
    THEN 'K|' || contact || '|' || bhk || '|' || location ELSE 'N' || id END AS triple_key FROM {source}),
rounds AS (
  SELECT id, text_key, triple_key, 0 AS state, 0 AS round FROM admission_keys
  UNION ALL
  SELECT id, text_key, triple_key,
         CASE WHEN state <> 0 THEN state WHEN entered_text < id OR entered_triple < id THEN 2
              WHEN first_text = id AND first_triple = id THEN 1 ELSE 0 END, round + 1
  FROM (SELECT *, min(id) FILTER (state = 1) OVER (PARTITION BY text_key) AS entered_text,
               min(id) FILTER (state = 1) OVER (PARTITION BY triple_key) AS entered_triple,
               min(id) FILTER (state <> 2) OVER (PARTITION BY text_key) AS first_text,
               min(id) FILTER (state <> 2) OVER (PARTITION BY triple_key) AS first_triple,
               min(state) OVER () AS least FROM rounds)
  WHERE least = 0)"""


def _by_day() -> str:
    day = f"scraped_at < TIMESTAMP '{STORED_BEFORE} 00:00:00'"
    return ",\n".join([
        f"earlier AS (SELECT * FROM listings WHERE {day})",
        f"fresh AS (SELECT * FROM listings WHERE NOT ({day}))",
        _admitted("earlier", "stored"),
    ])


_COPIED = """copied AS (SELECT * FROM fresh WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.raw_text = fresh.raw_text)
  QUALIFY row_number() OVER (PARTITION BY raw_text ORDER BY id) = 1)"""


def _space_chars() -> str:
    codes = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    return " || ".join(f"chr({c})" for c in codes)


def _near_copies() -> str:
    """Earlier conflicting documents per document, then the greedy choice one by one."""
    return f"""WITH RECURSIVE
usable AS (
  SELECT doc_id, source, text, substr(text, 1, 80) AS head,
         row_number() OVER (ORDER BY doc_id) AS n
  FROM (SELECT doc_id, source, trim(text, {_space_chars()}) AS text FROM documents)
  WHERE length(text) >= 50),
conflicts AS MATERIALIZED (
  SELECT b.n, list(a.n) AS earlier
  FROM usable a JOIN usable b ON a.source = b.source AND a.n < b.n
  WHERE contains(b.text, a.head) OR contains(a.text, b.head)
  GROUP BY b.n),
steps AS MATERIALIZED (
  SELECT u.n, coalesce(c.earlier, CAST([] AS BIGINT[])) AS earlier FROM usable u LEFT JOIN conflicts c USING (n)
  WHERE c.n IS NOT NULL OR u.n IN (SELECT unnest(earlier) FROM conflicts)),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n) AS step FROM steps),
walk AS (
  SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS kept
  UNION ALL
  SELECT w.step + 1,
         CASE WHEN list_has_any(w.kept, r.earlier) THEN w.kept ELSE list_append(w.kept, r.n) END
  FROM walk w JOIN ranked r ON r.step = w.step + 1),
kept AS (SELECT unnest(kept) AS n FROM walk WHERE step = (SELECT max(step) FROM walk))
SELECT doc_id, source FROM usable
WHERE n NOT IN (SELECT n FROM steps) OR n IN (SELECT n FROM kept)"""


def _near_copies_posts() -> str:
    return f"""WITH RECURSIVE {_posts()},
usable AS (
  SELECT post_id, group_id, scraped_at, trim(text, {_space_chars()}) AS text FROM posts),
headed AS (SELECT *, substr(text, 1, 80) AS head FROM usable WHERE length(text) >= 50),
conflicts AS MATERIALIZED (
  SELECT b.post_id AS n, list(a.post_id) AS earlier
  FROM headed a JOIN headed b
    ON a.group_id = b.group_id AND a.post_id < b.post_id
  WHERE contains(b.text, a.head) OR contains(a.text, b.head)
  GROUP BY b.post_id),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n) AS step FROM conflicts),
walk AS (
  SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS gone
  UNION ALL
  SELECT w.step + 1,
         CASE WHEN len(list_filter(r.earlier, lambda e: NOT list_contains(w.gone, e))) > 0
              THEN list_append(w.gone, r.n) ELSE w.gone END
  FROM walk w JOIN ranked r ON r.step = w.step + 1)
SELECT post_id, group_id FROM headed
WHERE post_id NOT IN (SELECT unnest(gone) FROM walk WHERE step = (SELECT max(step) FROM walk))"""


# ------------------------------------------------------------------ saved items

_LOG = "log AS (SELECT user_id AS listing_id, ts FROM events WHERE event_type = 'click')"
_SAVED = """saved AS (SELECT listing_id, '' AS note, max(ts) AS created_at FROM log
  GROUP BY listing_id HAVING count(*) % 2 = 1)"""
_TIME = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"


# ------------------------------------------------------------------ corpus


def _pairs() -> str:
    def text(col: str) -> str:
        return f"coalesce('\"' || {col} || '\"', 'null')"

    return f"""pairs AS (SELECT id, {_q(fv.TRAINING_PROMPT)} || raw_text AS prompt,
  '{{"gated_community": ' || coalesce(CAST(gated_community AS VARCHAR), 'null') ||
  ', "furnished": ' || {text('furnished')} || ', "available_from": ' || {text('available_from')} ||
  ', "amenities": ' || coalesce('["' || replace(amenities, '|', '", "') || '"]', 'null') || '}}' AS completion
  FROM listings WHERE length(raw_text) >= 30 AND (gated_community IS NOT NULL OR furnished IS NOT NULL
    OR available_from IS NOT NULL OR amenities IS NOT NULL))"""


def _cards() -> str:
    def money(col: str) -> str:
        return f"'Rs.' || format('{{:,}}', CAST(nullif({col}, 0) AS BIGINT))"

    details = ", ".join([
        "CASE WHEN gated_community THEN '[Gated]' END",
        "CASE WHEN no_brokerage THEN '[No Broker]' END",
        "'[' || food_preference || ']'",
        "'[Parking: ' || parking || ']'",
        "'[Floor ' || floor || ']'",
        f"'[Maint: ' || {money('maintenance')} || ']'",
        "'[Avail: ' || available_from || ']'",
        "'[' || listing_type || ']'",
        "CASE WHEN gender_preference <> 'any' THEN '[' || gender_preference || ' only]' END",
    ])
    return f"""SELECT id,
  coalesce(bhk, '?') || ' BHK | ' || coalesce(furnished, '-') || ' | ' || coalesce(location, 'Unknown') AS headline,
  'Rent: ' || coalesce({money('rent')}, 'Not mentioned') || ' | Deposit: ' || coalesce({money('deposit')}, '-') AS price,
  nullif(concat_ws(' | ', {details}), '') AS details,
  replace(amenities, '|', ', ') AS amenities, contact, post_url AS link,
  CAST(len(string_split(images, '|')) AS BIGINT) AS photos,
  replace(substr(raw_text, 1, 150), chr(10), ' ') || '...' AS preview
FROM listings"""


# ------------------------------------------------------------------ pages

_HREF = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']([^"']*)["']"""
_IMG = r"""(?i)<img\s[^>]*?\bsrc\s*=\s*["']([^"']*)["']"""


def _links() -> str:
    return f"""hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, {_q(_HREF)}, 1)) AS href,
    generate_subscripts(regexp_extract_all(html, {_q(_HREF)}, 1), 1) - 1 AS position FROM pages),
links AS (SELECT page_id, position, split_part(href, '?', 1) AS link FROM hrefs WHERE {_any('href', HREF_NEEDLES)})"""


def _title() -> str:
    def inner(tag: str) -> str:
        return f"nullif(regexp_extract(h, {_q(rf'(?is)<{tag}\b[^>]*>(.*?)</{tag}>')}, 1), '')"

    text = "regexp_replace(inside, '(?s)<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, {_q(entity)}, {_q(char)})"
    return f"""WITH headings AS (
  SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 0), '') AS h FROM pages),
inner_html AS (SELECT page_id, coalesce({inner('a')}, {inner('span')}, {inner('h1')}) AS inside FROM headings),
texts AS (SELECT page_id, trim({text}, {_space_chars()}) AS title FROM inner_html)
SELECT page_id, CASE WHEN length(title) > 2 AND title <> 'Notifications' THEN title END AS title FROM texts"""


# ------------------------------------------------------------------ all


def _where(name: str) -> str:
    return {
        "filter_min_rent": "rent IS NOT NULL AND rent >= 15000",
        "filter_max_rent": "rent IS NOT NULL AND rent <= 12000",
        "filter_bhk": "bhk = '2'",
        "filter_furnished": "furnished = 'semi'",
        "filter_gated": "gated_community",
        "filter_listing_type": "listing_type = 'flatmate'",
        "filter_food": "food_preference = 'any'",
        "filter_gender": "gender_preference = 'female'",
        "filter_gender_not": "(gender_preference <> 'female' OR gender_preference IS NULL)",
        "filter_no_brokerage": "no_brokerage",
        "filter_parking": "parking IS NOT NULL AND parking IN ('both', 'car')",
        "filter_location": "lower(location) LIKE '%konda%'",
        "filter_location_wildcard": "lower(location) LIKE '%hi_tech%y%'",
        "filter_has_contact": "contact IS NOT NULL",
        "filter_has_images": "images IS NOT NULL",
        "filter_has_rent": "rent IS NOT NULL",
        "filter_falsy": "TRUE",
    }[name]


def _top(order: str, limit: int, offset: int = 0, where: str = "TRUE", extra: str = "") -> str:
    return f"""SELECT {_outs((*SHOWN, 'created_at'))}{extra} FROM (
  SELECT *, row_number() OVER (ORDER BY {order} DESC NULLS LAST, id DESC) AS pos FROM listings WHERE {where})
WHERE pos > {offset} AND pos <= {offset} + {limit}"""


def _numbered(order: str, limit: int, offset: int = 0) -> str:
    return _sql(_top(order, limit, offset, extra=f", CAST(pos - {offset} AS BIGINT) AS number"))


def _paged(number: int) -> str:
    return _sql(
        f"""SELECT {_outs((*SHOWN, 'created_at'))}, CAST(total AS BIGINT) AS total, CAST(page AS BIGINT) AS page
FROM (SELECT *, row_number() OVER (ORDER BY rent DESC NULLS LAST, id DESC) AS pos, count(*) OVER () AS total,
        least({number}, greatest(1, CAST(ceil(count(*) OVER () / 12.0) AS BIGINT))) AS page
      FROM listings WHERE bhk = '2')
WHERE pos > (page - 1) * 12 AND pos <= page * 12"""
    )


def oracle_sql() -> dict[str, str]:
    stats = """count(*) AS total, count(rent) AS with_rent, count(contact) AS with_contact, count(images) AS with_images,
  count(*) FILTER (WHERE listing_type = 'full_flat') AS full_flat, count(*) FILTER (WHERE listing_type = 'flatmate') AS flatmate,
  count(*) FILTER (WHERE no_brokerage) AS no_brokerage, count(*) FILTER (WHERE food_preference = 'veg') AS veg"""
    found = {f"extract_{f}": _sql(f"SELECT post_id, {_out(f)} FROM fields") for f in FIELDS}
    found["extract_all"] = _sql(f"SELECT post_id, {_outs(FIELDS)} FROM fields")
    for name, column in (("classify_type", "listing_type"), ("classify_food", "food_preference"),
                         ("classify_gender", "gender_preference"), ("classify_brokerage", "no_brokerage")):
        found[name] = _sql(f"SELECT id, {_out(column)} FROM listings")
    for name, sql in (("furnished", _norm_furnished("text")), ("parking", _norm_parking("text")),
                      ("rent_text", _norm_rent_text("text")), ("bhk", _norm_bhk("text"))):
        found[f"normalize_{name}"] = _sql(f"SELECT post_id, {sql} AS {name.removesuffix('_text')} FROM posts")
    picked = f"{_list(SHORT_VALUES)}[1 + o_orderkey % {len(SHORT_VALUES)}]"
    found["normalize_short_values"] = f"""SELECT o_orderkey, {_norm_furnished("v")} AS furnished,
  {_norm_parking("v")} AS parking, {_norm_bhk("v")} AS bhk FROM (SELECT o_orderkey, {picked} AS v FROM orders)"""
    found["stored_search"] = _sql(f"SELECT {_outs(SHOWN)} FROM listings WHERE bhk = '2' AND rent IS NOT NULL")
    for name in FILTERS:
        found[name] = _sql(f"SELECT {_outs(SHOWN)} FROM listings WHERE {_where(name)}")
    found["facets_web"] = _sql(
        f"""SELECT {_outs(SHOWN)} FROM listings WHERE rent >= 8000 AND rent <= 20000 AND bhk = '2'
AND (gender_preference <> 'male' OR gender_preference IS NULL) AND contact IS NOT NULL AND parking IN ('both', 'car')"""
    )
    found["facets_command"] = _sql(
        f"""SELECT {_outs(SHOWN)} FROM listings WHERE rent <= {COMMAND_ARGS['max_rent']} AND furnished = 'semi'
AND food_preference = 'veg' AND no_brokerage AND contact IS NOT NULL"""
    )
    found["count_filtered"] = _sql("SELECT count(*) AS cnt FROM listings WHERE bhk = '2' AND rent IS NOT NULL")
    found |= {
        "top_rent": _numbered("rent", 50),
        "top_recent": _numbered("created_at", 20),
        "top_bhk": _numbered("bhk", 50, 25),
        "top_unknown_key": _numbered("created_at", 12),
        "page_3": _paged(3),
        "page_beyond_last": _paged(10**6),
    }
    enriched = ("bhk", "rent", "furnished", "parking", "listing_type", "food_preference", "gender_preference", "no_brokerage")
    found["enrich_listings"] = _sql(f"SELECT id, {_outs(enriched)} FROM listings")
    found["backfill"] = found["enrich_listings"]
    found["backfill_count"] = _sql("SELECT count(*) AS updated FROM listings")
    found["contact_in_documents"] = f"SELECT doc_id, {_first(fv.CONTACT, col='text')} AS contact FROM documents"
    bold = "translate(text, '𝟬𝟭𝟮𝟯𝟰𝟱𝟲𝟳𝟴𝟵', '0123456789')"
    found["phone_in_documents"] = f"SELECT doc_id, {_first(fv.CONTACT, col=bold)} AS contact FROM documents"
    classes = _classes("lower(text)")
    found["keywords_in_conversations"] = (
        f"SELECT conv_id, turn, {classes['listing_type']} AS listing_type, {classes['gender_preference']} AS gender_preference, "
        f"CAST(CAST({classes['no_brokerage']} AS INT) AS BIGINT) AS no_brokerage FROM conversations"
    )
    found["long_documents"] = (
        f"SELECT doc_id, CAST(length(t) AS BIGINT) AS chars FROM (SELECT doc_id, trim(text, {_space_chars()}) AS t FROM documents) "
        "WHERE length(t) >= 50"
    )
    model = ("bhk", "rent", "deposit", "sqft", "location", "gated_community", "furnished", "available_from", "floor",
             "parking", "facing", "maintenance", "lease_duration", "amenities", "empty")
    found["decoded_predictions"] = _sql(
        "SELECT post_id, " + ", ".join(
            f"CAST(CAST(model_{m} AS INT) AS BIGINT) AS model_{m}" if m in ("gated_community", "empty") else f"model_{m}"
            for m in model
        ) + " FROM decoded",
        _decoded(),
    )
    found["merged_fields"] = _sql(f"SELECT post_id, {_outs(FIELDS)} FROM merged", _decoded(), _merged())
    shown = ("bhk", "rent", "furnished", "parking", "location", "gated_community", "available_from", "listing_type", "food_preference")
    found["merged_listings"] = _sql(
        f"SELECT id, {_outs(shown)} FROM enriched", _decoded(), _merged(), _listings("merged", "enriched")
    )
    found["merged_admission"] = found["stream_ingest_merged"] = _sql(
        "SELECT id, contact, bhk, location FROM enriched WHERE id IN (SELECT id FROM rounds WHERE state = 1 AND round = (SELECT max(round) FROM rounds))",
        _decoded(), _merged(), _listings("merged", "enriched"), _rounds("enriched"),
    )
    found["reextracted"] = _sql(
        f"""SELECT id, o->>'bhk' AS bhk, TRY_CAST(o->>'rent' AS BIGINT) AS rent, o->>'location' AS location,
  o->>'furnished' AS furnished, o->>'available_from' AS available_from, {_first(fv.CONTACT, col='raw_text')} AS contact,
  array_to_string(CAST(o->'amenities' AS VARCHAR[]), '|') AS amenities
FROM listings JOIN said USING (post_id) WHERE CAST(o AS VARCHAR) <> '{{}}'""",
        f"""outputs AS (SELECT post_id, regexp_extract({_list(fixture.MODEL_OUTPUT)}[1 + post_id % 8],
    {_q("(?s)" + fv.MODEL_JSON_WIDEST)}) AS j FROM posts WHERE post_id % 8 <> 0)""",
        "said AS (SELECT post_id, CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS o FROM outputs)",
    )
    found["result_cards"] = _sql(_cards())
    found["newest_matches"] = _sql(
        f"""SELECT {_outs((*SHOWN, 'contact', 'created_at'))}, CAST(number AS BIGINT) AS number FROM (
  SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id DESC) AS number FROM admitted
  WHERE bhk = '2' AND rent <= 20000 AND contact IS NOT NULL AND lower(location) LIKE '%n%') WHERE number <= 50""",
        _admitted("listings", "admitted"),
    )
    found["dedupe_text"] = _sql(
        "SELECT min(id) AS id, raw_text FROM listings GROUP BY raw_text"
    )
    found["dedupe_triple"] = _sql(
        """SELECT id, contact, bhk, location FROM listings l WHERE NOT EXISTS (SELECT 1 FROM listings e
  WHERE e.contact = l.contact AND e.bhk = l.bhk AND e.location = l.location AND e.id < l.id)"""
    )
    found["admit_new"] = _sql(
        f"""SELECT id, contact, bhk, location FROM batch WHERE {_entry()} NOT IN (SELECT {_entry()} FROM stored)""",
        _by_day(), _admitted("fresh", "batch"),
    )
    found["copy_new"] = _sql("SELECT id, raw_text FROM copied", _by_day(), _COPIED)
    found["copy_counts"] = _sql(
        "SELECT (SELECT count(*) FROM fresh) AS attempted, (SELECT count(*) FROM copied) AS written", _by_day(), _COPIED
    )
    found["near_copies"] = found["stream_near_copies"] = _near_copies()
    found["near_copies_posts"] = _near_copies_posts()
    found["dashboard"] = _sql(f"SELECT {stats} FROM listings")
    found["sync_report"] = _sql("SELECT count(*) AS total, count(rent) AS with_rent, count(contact) AS with_contact FROM listings")
    found["run_counters"] = _sql(
        """SELECT group_id, count(*) AS parsed, count(*) FILTER (WHERE id IN (SELECT id FROM admitted)) AS new,
  CAST(0 AS BIGINT) AS failed, CAST(grouping(group_id) AS BIGINT) AS is_total FROM listings GROUP BY ROLLUP (group_id)""",
        _admitted("listings", "admitted"),
    )
    found["fill_rates"] = _sql(
        " UNION ALL ".join(
            f"SELECT '{f}' AS field, count({f}) AS filled, count({f}) / count(*) AS rate FROM fields" for f in FIELDS
        )
    )
    found["toggle_fold"] = f"WITH {_LOG}, {_SAVED} SELECT listing_id, note, {_TIME} FROM saved"
    found["toggle_fold_started"] = f"""WITH {_LOG},
before AS (SELECT user_id AS listing_id, min(ts) AS bought FROM events WHERE event_type = 'purchase' GROUP BY user_id),
toggles AS (SELECT listing_id, count(*) AS n, max(ts) AS last FROM log GROUP BY listing_id),
state AS (SELECT listing_id, bought, coalesce(n, 0) AS n, last FROM before FULL JOIN toggles USING (listing_id))
SELECT listing_id, CASE WHEN n > 0 THEN '' ELSE 'bought' END AS note,
  strftime(CASE WHEN n > 0 THEN last ELSE bought END, '%Y-%m-%d %H:%M:%S') AS created_at
FROM state WHERE (n + CASE WHEN bought IS NULL THEN 0 ELSE 1 END) % 2 = 1"""
    found["saved_listings"] = _sql(
        f"""SELECT {', '.join(_out(c) if c in NUMBERS else 'l.' + c for c in SHOWN)}, note AS saved_note,
  strftime(s.created_at, '%Y-%m-%d %H:%M:%S') AS saved_at FROM listings l JOIN saved s ON l.id = s.listing_id""",
        _LOG, _SAVED,
    )
    found["saved_flag"] = _sql(
        "SELECT id, bhk, CAST(CAST(id IN (SELECT listing_id FROM saved) AS INT) AS BIGINT) AS saved FROM listings", _LOG, _SAVED
    )
    found["saved_add"] = _sql(
        f"""SELECT listing_id, note, {_TIME} FROM saved UNION ALL
SELECT listing_id, note, {_TIME} FROM (SELECT user_id AS listing_id, event_type AS note, ts AS created_at FROM events
  WHERE event_type <> 'click' AND user_id IN (SELECT id FROM listings) AND user_id NOT IN (SELECT listing_id FROM saved)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) = 1)""",
        _LOG, _SAVED,
    )
    found["saved_remove"] = f"""WITH {_LOG}, {_SAVED} SELECT listing_id, note, {_TIME} FROM saved
WHERE listing_id NOT IN (SELECT user_id FROM events WHERE value > 100)"""
    found["training_pairs"] = _sql("SELECT id, prompt, completion FROM pairs", _pairs())
    found["chat_turns"] = _sql(
        f"""SELECT id, CAST(0 AS BIGINT) AS turn, 'system' AS role, {_q(fv.TRAINING_SYSTEM)} AS content FROM pairs UNION ALL
SELECT id, 1, 'user', prompt FROM pairs UNION ALL SELECT id, 2, 'assistant', completion FROM pairs""",
        _pairs(),
    )
    found["split_ordered"] = _sql(
        """SELECT id, CASE WHEN row_number() OVER (ORDER BY id) <= floor(count(*) OVER () * CAST(0.9 AS DOUBLE))
  THEN 'train' ELSE 'valid' END AS split FROM pairs""",
        _pairs(),
    )
    found["split_seeded"] = _sql(
        """SELECT id, CASE WHEN row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:' || id), 1, 15) AS BIGINT), id)
  <= ceil(count(*) OVER () / 10.0) THEN 'valid' ELSE 'train' END AS split FROM pairs""",
        _pairs(),
    )
    found["page_links"] = f"WITH {_links()} SELECT page_id, CAST(position AS BIGINT) AS position, link FROM links"
    found["page_post_link"] = f"""WITH {_links()} SELECT p.page_id, f.link FROM pages p LEFT JOIN (
  SELECT page_id, arg_min(link, position) AS link FROM links GROUP BY page_id) f USING (page_id)"""
    found["page_images"] = f"""SELECT page_id, array_to_string(list_filter(regexp_extract_all(html, {_q(_IMG)}, 1),
  lambda s: {_any('s', fv.IMAGE_NEEDLES)} AND NOT {_any('s', fv.IMAGE_EXCLUDED)}), '|') AS images FROM pages"""
    found["page_title"] = _title()
    found["post_groups"] = _sql(
        """SELECT post_id, CASE WHEN group_id % 5 <> 4 THEN 'Group ' || group_id END AS group_name,
  'https://groups.example/' || group_id AS group_url, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at,
  images, post_url FROM posts"""
    )
    found["boundary_form"] = _sql(
        """SELECT id, '["' || replace(amenities, '|', '","') || '"]' AS as_text, coalesce(amenities, '') AS as_array FROM listings"""
    )
    found["stream_ingest_listings"] = _sql(
        "SELECT id, contact, bhk, location FROM admitted", _admitted("listings", "admitted")
    )
    found["page_last_by_rank"] = found["page_beyond_last"]
    found["top_bhk_by_rank"] = _numbered("bhk", 50, 1000)
    found["top_recent_by_rank"] = _numbered("created_at", 20, 700)
    found["extract_styled_digits"] = found["extract_all"]
    found["repeated_keys"] = """SELECT o_orderkey AS post_id, CAST(o_orderkey % 5 + 1 AS VARCHAR) AS model_bhk,
  5000 + o_orderkey % 100 * 100 AS model_rent, CAST(NULL AS VARCHAR) AS model_floor, CAST(0 AS BIGINT) AS model_empty FROM orders"""
    found["json_listings"] = found["json_arrays"] = found["stored_search"]
    found["published_renewal"] = found["reextracted"]
    found["run_counters_failed"] = _sql(
        f"""SELECT group_id, count(*) FILTER (WHERE id % {FAILING} <> 0) AS parsed,
  count(*) FILTER (WHERE id IN (SELECT id FROM admitted)) AS new, count(*) FILTER (WHERE id % {FAILING} = 0) AS failed,
  CAST(grouping(group_id) AS BIGINT) AS is_total FROM listings GROUP BY ROLLUP (group_id)""",
        f"whole AS (SELECT * FROM listings WHERE id % {FAILING} <> 0)", _admitted("whole", "admitted"),
    )
    found["saved_remove_some"] = f"""WITH {_LOG}, {_SAVED} SELECT listing_id, note, {_TIME} FROM saved
WHERE listing_id % 3 <> 0"""
    found["training_files"] = _sql("SELECT prompt, completion FROM pairs", _pairs())
    found["chat_files"] = f"SELECT turn, role, content FROM ({found['chat_turns']})"

    def as_json(column: str) -> str:
        return f"""'["' || replace({column}, '|', '","') || '"]'"""

    def flag(column: str) -> str:
        return f"CAST(CAST(coalesce({column}, FALSE) AS INT) AS BIGINT)"

    found["boundary_rows"] = _sql(
        f"""SELECT id, {as_json('amenities')} AS amenities, {as_json('images')} AS images,
  {flag('gated_community')} AS gated_community, {flag('no_brokerage')} AS no_brokerage,
  coalesce(amenities, '') AS amenities_back, coalesce(images, '') AS images_back,
  {flag('gated_community')} AS gated_community_back, {flag('no_brokerage')} AS no_brokerage_back FROM listings"""
    )
    # What each text stands for: only whole arrays have values.
    values = ("a|b", "", "", "", "", "x", "", 'q"r', "", "", "")
    found["boundary_values"] = f"SELECT o_orderkey, {_list(values)}[1 + o_orderkey % {len(values)}] AS found FROM orders"
    named = """SELECT DISTINCT CAST(o_custkey % 16 AS BIGINT) AS group_id, 'https://groups.example/' || (o_custkey % 16) AS url,
  CASE WHEN o_custkey % 16 % 5 <> 4 THEN 'Group ' || (o_custkey % 16) END AS name FROM orders"""
    found["groups_file"] = named
    found["groups_yaml"] = f"SELECT row_number() OVER (ORDER BY url) - 1 AS group_id, url, name FROM ({named})"
    found["stream_unique_within"] = _sql("SELECT DISTINCT text FROM posts")
    found["stream_toggle"] = found["toggle_fold"]
    found["stream_group_totals"] = _sql(
        "SELECT CAST(group_id AS BIGINT) AS group_id, count(*) AS parsed, CAST(0 AS BIGINT) AS failed FROM posts GROUP BY group_id"
    )
    return found
