"""Column functions over text: numeric prefixes, paths, entities, embedded metadata, enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
INTEGER = r"^[+-]?[0-9]+"


def prefix_double(s: Column) -> Column:
    """SC-08: the longest numeric prefix, else 0."""
    return F.coalesce(F.regexp_extract(F.ltrim(s), NUMBER, 0).try_cast("double"), F.lit(0.0))


def prefix_long(s: Column) -> Column:
    """SC-09: the longest whole prefix, else 0."""
    return F.coalesce(F.regexp_extract(F.ltrim(s), INTEGER, 0).try_cast("long"), F.lit(0))


def fixed(x: Column, digits: int) -> Column:
    """AG-08, ST-09: C's %.<digits>f of a double: its exact binary value is rounded, and a true tie goes to the even digit
    (format_string rounds the shortest decimal form, ties away from zero)."""
    shape = F.lit("0." + "0" * digits)
    shown = lambda v: F.call_function("format_number", v, shape)
    size = F.abs(x)
    part = shown(size - F.floor(size))  # exact, where the whole number has more digits than format_number keeps
    split = F.concat(F.when(x < 0, "-").otherwise(""), (F.floor(size) + part.substr(1, 1).cast("long")).cast("string"), F.substring(part, 2, digits + 1))
    name = F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x < 0, "-inf").otherwise("inf"))
    return F.when(F.isnan(x) | (size == float("inf")), name).when((size >= 1e9) & (size < 2.0**63), split).otherwise(shown(x))


def file_name(path: Column) -> Column:
    """ST-02: what follows the last slash of either kind."""
    return F.regexp_extract(F.translate(path, "\\", "/"), "([^/]*)$", 1)


def directory(path: Column) -> Column:
    """ST-02: what stands before the last slash, '' for none."""
    return F.regexp_extract(F.translate(path, "\\", "/"), "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """ST-01, ST-02: lower-case extension without the dot, '' for none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    """ST-02: file name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def storage_path(root: Column, partition: Column, relative: Column, name: Column) -> Column:
    """ST-03: parts joined by slashes; without a relative part the root alone."""
    blank = lambda c: F.when(c != "", c)
    return F.when(F.coalesce(relative, F.lit("")) == "", root).otherwise(F.concat_ws("/", root, blank(partition), relative, blank(name)))


def unescaped(s: Column) -> Column:
    """ST-04: entities by their first letter: l is <, g is >, a is &, # is dropped, anything else is & and that
    character. An entity that doesn't end takes the rest with it. A state machine over the characters."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("state"))  # 0 text, 1 after &, 2 inside an entity

    def turn(a: Column, c: Column) -> Column:
        letter = F.when(c == "l", "<").when(c == "g", ">").when(c == "a", "&").when(c == "#", "")
        out = F.when(a["state"] == 0, F.when(c == "&", a["out"]).otherwise(F.concat(a["out"], c)))
        out = out.when(a["state"] == 1, F.when(letter.isNotNull(), F.concat(a["out"], letter)).otherwise(F.concat(a["out"], F.lit("&"), c))).otherwise(a["out"])
        state = F.when(a["state"] == 0, F.when(c == "&", 1).otherwise(0)).when(a["state"] == 1, F.when(letter.isNotNull(), 2).otherwise(0)).otherwise(F.when(c == ";", 0).otherwise(2))
        return F.struct(out.alias("out"), state.alias("state"))

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), start, turn, lambda a: a["out"])


#: The marker and the element that hold a description in image metadata; the marker is a parameter of its writer.
MARKER, DESCRIPTION = "!image_server:", "<dc:description>"


def embedded_description(xmp: Column, marker: str = MARKER) -> Column:
    """SC-25: the text after the marker in the description, up to ]]> or else the next <; '' if it is missing."""
    after = F.regexp_extract(xmp, f"(?s){DESCRIPTION}.*?{marker}(.*)$", 1)
    return F.when(F.contains(after, F.lit("]]>")), F.substring_index(after, "]]>", 1)).otherwise(F.substring_index(after, "<", 1))


def encoded_description(text: Column, marker: str = MARKER) -> Column:
    """SC-24: well-formed metadata with the text in a CDATA section."""
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/">'
    return F.concat(F.lit(head + DESCRIPTION + "<![CDATA[" + marker), text, F.lit("]]></dc:description></rdf:Description></rdf:RDF></x:xmpmeta>"))


def tiff_tag(xmp: Column, tag: str) -> Column:
    """SC-26: number of a tag such as Orientation or XResolution, 0 if it is missing."""
    return prefix_double(F.regexp_extract(xmp, f"tiff:{tag}='([^']*)'", 1))


def sample_ids(s: Column) -> Column:
    """ST-05: numbers of a list that is parted by the letter o."""
    return F.transform(F.filter(F.split(s, "o"), lambda x: x != ""), prefix_long)


def padded(n: Column, width: int) -> Column:
    """ST-07."""
    return F.lpad(n.cast("string"), width, "0")


# Short and long names of the estimators and names of the transition types.
ESTIMATORS = {"standard": ("flexible", " using a flexible state ordering scheme"), "strict_ordering": ("strict", " using a restricted state ordering scheme"), "simultaneous_movement_cessation_and_expansion": ("simultaneous", " requiring synchronous movement cessation and expansion ")}
TRANSITION_TYPES = {"static": "static", "static_mod": "static_mod", "empirical": "empirical", "empirical_without_weights": "empirical_no_weights"}


def label_of(code: Column, labels: dict[str, str]) -> Column:
    """ST-08: the label of a code; an unknown code fails."""
    out = F.when(F.lit(False), F.lit(""))
    for k, v in labels.items():
        out = out.when(code == k, v)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown type: "), code)).cast("string"))


def transition_text(a: Column, b: Column) -> Column:
    """PF-17."""
    return F.concat(a, F.lit("->"), b)


def transition_parts(s: Column) -> Column:
    """PF-17: (from, to) of a transition."""
    return F.struct(F.substring_index(s, "->", 1).alias("from_state"), F.substring_index(s, "->", -1).alias("to_state"))


def is_state(s: Column) -> Column:
    """PF-17: a state and not a transition."""
    return F.instr(s, "->") == 0


def frame_label(i: Column, n: Column) -> Column:
    """ST-10."""
    return F.concat(i.cast("string"), F.lit("/"), n.cast("string"))
