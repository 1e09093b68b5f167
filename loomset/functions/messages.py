"""Messages about failures as column expressions: causes, hints, rejections of submitted jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset.functions import text as T

#: Statuses after which a second try can succeed.
TRANSIENT = {429: "rate limited", 500: "internal error", 502: "bad gateway", 503: "overloaded", 504: "timed out"}
ADVICE = "Try again in a minute, or use another model."
LONGEST = 300

#: What to do about a failed image, by what its error says; the first rule that holds counts.
HINTS = [
    (("found no",), "name the subject otherwise, or leave isolation off for this image"),
    (("gated", "authenticate"), "accept the model's licence and set its access token, or use another backend"),
    (("comfyui",), "start the workflow server, or use a built-in backend"),
    (("cannot identify", "truncated", "decoder"), "the file is damaged or no image: export it again or drop it"),
]
NO_HINT = "see the log for the whole message"

REJECTION = """error struct<type: string, message: string, details: string, extra_info: struct<class_type: string>>,
    node_errors map<string, struct<class_type: string, errors: array<struct<message: string, details: string, extra_info: struct<input_name: string>>>>>"""


def is_transient(status: Column) -> Column:
    return F.coalesce(status.isin(list(TRANSIENT)), F.lit(False))


def shortened(c: Column, longest: int = LONGEST) -> Column:
    flat = T.squeeze(c)
    return F.when(F.length(flat) > longest, F.concat(F.left(flat, F.lit(longest)), F.lit("…"))).otherwise(flat)


def friendly_error(status: Column, message: Column, kind: str = "error") -> Column:
    """A known cause with advice, else the message on one line, cut; never empty."""
    causes = F.create_map(*(F.lit(x) for code, cause in TRANSIENT.items() for x in (code, f"{cause} ({code}). {ADVICE}")))
    return F.coalesce(F.try_element_at(causes, status.cast("int")), F.nullif(shortened(message), F.lit("")), F.lit(kind))


def failure_hint(error: Column) -> Column:
    low, out = F.lower(T.empty(error)), None
    for needles, hint in HINTS:
        holds = F.greatest(*(F.contains(low, F.lit(n)) for n in needles)) if len(needles) > 1 else F.contains(low, F.lit(needles[0]))
        out = F.when(holds, hint) if out is None else out.when(holds, hint)
    return out.otherwise(NO_HINT)


def plain(markdown: Column) -> Column:
    """Without the marks of emphasis and code."""
    return F.replace(F.replace(T.empty(markdown), F.lit("**"), F.lit("")), F.lit("`"), F.lit(""))


def rejection(body: Column) -> Column:
    """One sentence for a rejected job: an unknown node, the nodes' errors, the headline, or the body's start."""
    full = lambda c: F.coalesce(c, F.lit(""))
    got = F.from_json(body, REJECTION)
    error, headline = got["error"], F.coalesce(F.nullif(got["error"]["message"], F.lit("")), F.lit("job rejected"))
    each = lambda node: F.transform(
        F.coalesce(node["value"]["errors"], F.array()),
        lambda e: F.concat(
            F.coalesce(node["value"]["class_type"], F.lit("?")), F.lit(" (node "), node["key"], F.lit(")"),
            F.when(full(e["extra_info"]["input_name"]) != "", F.concat(F.lit(" input '"), e["extra_info"]["input_name"], F.lit("'"))).otherwise(""),
            F.lit(": "), F.coalesce(F.nullif(e["details"], F.lit("")), full(e["message"])),
        ),
    )
    parts = F.array_join(F.flatten(F.transform(F.map_entries(got["node_errors"]), each)), "; ")
    node = F.coalesce(F.nullif(error["extra_info"]["class_type"], F.lit("")), F.lit("?"))
    said = F.when(full(error["type"]) == "missing_node_type", F.concat(F.lit("unknown node '"), node, F.lit("': update the server or install it")))
    said = said.when(full(parts) != "", F.concat(headline, F.lit(" — "), parts)).when(full(error["details"]) != "", F.concat(headline, F.lit(" — "), error["details"])).otherwise(headline)
    is_object = full(F.get_json_object(body, "$")).startswith("{")
    return F.when(is_object, said).otherwise(F.concat(F.lit("job rejected: "), F.left(full(body), F.lit(LONGEST))))


def waiting(body: Column, field: str = "queue_pending") -> Column:
    """How many jobs wait, by a service's answer about its queue; 0 where it says nothing of them."""
    return F.coalesce(F.json_array_length(F.get_json_object(body, f"$.{field}")), F.lit(0)).cast("long")


def missing_nodes(wanted: Column, installed: Column) -> Column:
    """Sorted classes that are wanted and not installed; none where nothing is known of the server."""
    absent = F.array_sort(F.array_except(F.array_compact(wanted), installed))
    return F.when(F.size(F.coalesce(installed, F.array().cast("array<string>"))) > 0, absent).otherwise(F.array().cast("array<string>"))
