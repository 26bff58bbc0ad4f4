"""Names, paths, identifiers, dates and small text rules as column expressions.

Nulls give null unless a function says otherwise. Rules that try substrings in order take the first that fits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: what a substring of a name stands for, in the order of trial.
SENSOR_OF_FILE = (("ohr", "OHRC"), ("tmc", "TMC2"), ("iir", "IIRS"), ("sar", "DFSAR"))
SENSOR_OF_TOKEN = (("OHR", "OHRC"), ("IIR", "IIRS"), ("TMC", "TMC2"), ("NAC", "LRO_NAC"))
ILLUMINATION = ("solar", "sun", "incidence", "emission", "phase", "illum")
COORDINATE = ("latitude", "longitude", "lat", "lon", "corner", "coordinate")
TIME = ("time", "date", "utc", "sclk")
RECORDED_AS = (("ode_", "ODE", "ODE_METADATA"), ("edr_", "PDS_LROC", "LRO_NAC_EDR"), ("tc_dtm_", "DARTS", "SELENE_DTM"), ("tc_", "DARTS", "SELENE_TC"), ("spice_", "PDS_IMG", "DOC"))
ROLE_OF_SUFFIX = {".img": "data", ".lbl": "label", ".xml": "label", ".json": "metadata"}
EQUATORIAL_CRS = 100009
PAIR_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
_TOKEN = r"(\d{8}[Tt]\d{10})"


def _first(pairs, test, otherwise: Column) -> Column:
    out = otherwise
    for key, value in reversed(list(pairs)):
        out = F.when(test(key), F.lit(value)).otherwise(out)
    return out


def _null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The file name less its last suffix; a name that only begins with a dot has none."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The last suffix with its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def product_type(path: Column) -> Column:
    """browse, geometry, data or other, by the file name."""
    name = F.lower(file_name(path))
    data = name.contains("_d_img_") | name.contains("_d_cub_") | name.endswith("_100cm.xml") | name.endswith(".lbl")
    return F.when(name.contains("_b_brw_"), "browse").when(name.contains("_g_grd_"), "geometry").when(data, "data").otherwise("other")


def level(instrument: Column, name: Column) -> Column:
    """raw, calibrated, derived or unknown, by instrument and the third token of a file's stem."""
    low = F.lower(name)
    token = F.coalesce(F.get(F.split(low, "_"), F.lit(2)), F.lit(""))
    second = F.substring(token, 2, 1)
    ohrc = F.when(token == "nrp", "raw").when(token == "ncp", "calibrated").otherwise("unknown")
    cubes = F.when(low.contains("_d_oth_") | low.contains("_d_dtm_"), "derived").when(second == "r", "raw").when(second == "c", "calibrated").otherwise("unknown")
    selene = F.when(low.startswith("tco_map"), "derived").otherwise("raw")
    return F.when(instrument == "OHRC", ohrc).when(instrument.isin("TMC2", "IIRS"), cubes).when(instrument.isin("LRO_NAC", "LRO_NAC_DTM"), "derived").when(instrument == "SELENE_TC", selene).otherwise("unknown")


def sensor_of_file(name: Column) -> Column:
    return _first(SENSOR_OF_FILE, F.lower(name).contains, F.lit("UNKNOWN"))


def guess_sensor(*texts: Column) -> Column:
    """The sensor whose token stands in any of the texts; null if none does."""
    joined = F.upper(F.concat_ws(" ", *texts))
    return _first(SENSOR_OF_TOKEN, joined.contains, F.lit(None).cast("string"))


def element_category(name: Column) -> Column:
    """illumination, coordinate, time or null, by what the name of a label's element holds."""
    low = F.lower(name)

    def holds(words):
        found = F.lit(False)
        for w in words:
            found = found | low.contains(w)
        return found

    return F.when(holds(ILLUMINATION), "illumination").when(holds(COORDINATE), "coordinate").when(holds(TIME), "time")


def local_name(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^.*\}", "")


def namespace(tag: Column) -> Column:
    return _null_if_empty(F.regexp_extract(tag, r"^\{([^}]*)\}", 1))


def path_segment(segment: Column) -> Column:
    """struct(name, child, value) of ``Name`` or ``Name[child=value]``; null if malformed."""
    whole = r"^([^\[\]=/]+)(?:\[([^\[\]=/]+)=([^\[\]/]*)\])?$"
    child = _null_if_empty(F.regexp_extract(segment, whole, 2))
    return F.when(segment.rlike(whole), F.struct(F.regexp_extract(segment, whole, 1).alias("name"), child.alias("child"), F.when(child.isNotNull(), F.regexp_extract(segment, whole, 3)).alias("value")))


def path_segments(path: Column) -> Column:
    """The parsed segments of a label path; null if any is malformed."""
    found = F.transform(F.split(path, "/"), lambda s: path_segment(s))
    return F.when(F.forall(found, lambda s: s.isNotNull()), found)


def is_contained(path: Column) -> Column:
    """Whether a path stays below the folder it is given in: neither absolute nor through ``..``."""
    return ~path.rlike(r"(^/|(^|/)\.\.(/|$))")


def tar_name(name: Column) -> Column:
    return F.regexp_replace(name, r"^\./", "")


def tar_member_status(name: Column, kind: Column) -> Column:
    """REFUSED_UNSAFE, REFUSED_OUTSIDE_DATA or null (may be extracted); ``kind`` is file, dir or anything else."""
    plain = tar_name(name)
    unsafe = ~is_contained(plain) | ~kind.isin("file", "dir")
    inside = plain.startswith("data/") | ((kind == "dir") & (F.rtrim(plain, F.lit("/")) == "data"))
    return F.when(unsafe, "REFUSED_UNSAFE").when(~inside, "REFUSED_OUTSIDE_DATA")


def is_excluded(path: Column, files=(), names=(), prefixes=(), patterns=()) -> Column:
    """Whether a relative path is one of ``files``, is called one of ``names``, begins with one of ``prefixes`` or is like one of ``patterns``."""
    out = path.isin(*files) | file_name(path).isin(*names)
    for p in prefixes:
        out = out | path.startswith(p)
    for p in patterns:
        out = out | path.like(p)
    return out


def safe_stem(text: Column, fallback: Column) -> Column:
    """Letters, digits, - and _ stay, all else becomes _; the last 60 characters; ``fallback`` for null and empty."""
    return F.when(text != "", F.regexp_extract(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_"), r"(.{0,60})$", 1)).otherwise(fallback)


def stamp(created: Column) -> Column:
    """A time as part of a file name; "unknown" for null and empty."""
    return F.regexp_replace(F.when(created != "", created).otherwise("unknown"), r"[^\p{L}\p{N}_.-]", "-")


def is_pair_id(text: Column) -> Column:
    return F.coalesce(text.rlike(PAIR_ID), F.lit(False))


def checked_pair_id(text: Column) -> Column:
    """``text`` itself; the query fails on one that is no pair id."""
    return F.when(is_pair_id(text), text).otherwise(F.raise_error(F.concat(F.lit("invalid pair_id: "), F.coalesce(text, F.lit("NULL")))))


def timestamp_tag(product_id: Column) -> Column:
    """The token of date and time in an id, else the id with all but letters, digits, . and _ replaced ("product" if empty)."""
    safe = F.regexp_replace(product_id, r"[^A-Za-z0-9._]", "_")
    return F.coalesce(_null_if_empty(F.regexp_extract(product_id, r"(\d{8}T\d{10})", 1)), _null_if_empty(safe), F.lit("product"))


def grid_key(label_path: Column, product_id: Column) -> Column:
    """The token of date and time of the id, else of the label's file, with an upper-case T; null if neither has one."""
    token = F.coalesce(_null_if_empty(F.regexp_extract(product_id, _TOKEN, 1)), _null_if_empty(F.regexp_extract(stem(label_path), _TOKEN, 1)))
    return F.upper(token)


def sensor_name(instrument: Column, level_: Column) -> Column:
    short = F.when((instrument == "OHRC") & (level_ == "raw"), "RAW").when((instrument == "OHRC") & (level_ == "calibrated"), "CAL").otherwise(F.upper(level_))
    return F.concat(F.lit("CH2_"), instrument, F.lit("_"), short)


def variant(model: Column, preprocess: Column) -> Column:
    return F.concat(F.when(model == "homography", "").otherwise(F.concat(F.lit("_"), model)), F.when(preprocess == "none", "").otherwise(F.concat(F.lit("_pp-"), preprocess)))


def variant_of_pair(pair_id: Column, reference_sensor: Column, matcher: Column) -> Column:
    """What follows ``-<reference>_<matcher>`` in a pair id, or the whole id where that doesn't stand in it."""
    head = F.concat(F.lit("-"), reference_sensor, F.lit("_"), matcher)
    at = F.instr(pair_id, head)
    return F.when(at == 0, pair_id).otherwise(F.substring(pair_id, at + F.length(head), F.length(pair_id)))


def crs_code(name: Column) -> Column:
    """The digits after the last colon of a CRS name, or the equatorial code."""
    tail = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^:]*)$", 1)
    return F.when(tail.rlike(r"^\d+$"), tail.cast("int")).otherwise(EQUATORIAL_CRS)



def as_float(text: Column) -> Column:
    """The number that a text holds, or null."""
    return text.try_cast("double")


def plain_cell(value: Column) -> Column:
    """A number as JSON has it: NaN becomes null."""
    return F.when(~F.isnan(value), value)


def fit_sample(head: Column, path: Column, error: Column, most: int = 200) -> Column:
    """``head path: error`` in ``most`` characters: the error whole up to 120, the path cut from its left."""
    error = F.when(F.length(error) <= 120, error).otherwise(F.concat(F.substring(error, 1, 117), F.lit("...")))
    room = most - F.length(head) - F.length(error) - 3
    keep = F.greatest(room - 3, F.lit(0))
    cut = F.concat(F.lit("..."), F.substring(path, F.length(path) - keep + 1, keep))
    return F.substring(F.concat(head, F.lit(" "), F.when(F.length(path) > room, cut).otherwise(path), F.lit(": "), error), 1, most)


def csv_list(text: Column) -> Column:
    """The trimmed parts between commas that aren't empty."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def tile_sizes(text: Column) -> Column:
    """The positive integers of a comma list; null if any part is none or nothing is left."""
    sizes = F.transform(csv_list(text), lambda x: x.try_cast("int"))
    return F.when((F.size(sizes) > 0) & F.forall(sizes, lambda v: F.coalesce(v > 0, F.lit(False))), sizes)


def recorded_as(key: Column, dest: Column) -> Column:
    """struct(source, instrument, role, product_id) of a download, by the prefix of its key and its file's suffix."""
    source = _first(((p, s) for p, s, _ in RECORDED_AS), key.startswith, F.lit(None).cast("string"))
    instrument = _first(((p, i) for p, _, i in RECORDED_AS), key.startswith, F.lit(None).cast("string"))
    end = suffix(dest)
    role = _first(ROLE_OF_SUFFIX.items(), lambda s: end == s, F.lit("misc"))
    return F.struct(source.alias("source"), instrument.alias("instrument"), role.alias("role"), stem(dest).alias("product_id"))


def field_index(names: Column) -> Column:
    """map of lower-case field name to its position, from 0; the last of equal names counts."""
    low = F.transform(names, lambda n: F.lower(F.trim(n)))
    keep = F.filter(F.sequence(F.lit(0), F.size(low) - 1), lambda i: ~F.array_contains(F.slice(low, i + 2, F.size(low)), F.get(low, i)))
    return F.map_from_arrays(F.transform(keep, lambda i: F.get(low, i)), keep)


def looks_like_header(fields: Column) -> Column:
    """Whether any field of a row is no number."""
    return F.exists(fields, lambda x: F.trim(x).try_cast("double").isNull())


def scalar_meta(meta: Column, prefix: str = "matcher_") -> Column:
    """A map's entries that aren't null, their keys with a prefix."""
    return F.transform_keys(F.map_filter(meta, lambda k, v: v.isNotNull()), lambda k, v: F.concat(F.lit(prefix), k))


def utc(text: Column) -> Column:
    """The instant of an ISO text (Z and offsets honoured), or null."""
    return F.try_to_timestamp(text)


def utc_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def mid_time(start: Column, stop: Column) -> Column:
    """The instant half-way, to the microsecond below."""
    first = F.unix_micros(start)
    return F.timestamp_micros(first + F.floor((F.unix_micros(stop) - first) / 2).cast("long"))


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)
