"""Prompt and reply text: rendering, templates, reading agent replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.files import attached_extension, file_type_attached
from corpusloom.functions.text import base_name, js_trim, strip_control, xml_escape

FENCE = "```"

# The four conversation flows.
FLOWS = {
    (True, True): "DEEP_REACT_AGENT",
    (True, False): "LOCAL_RAG",
    (False, True): "GLOBAL_REACT_AGENT",
    (False, False): "DIRECT_LLM",
}
# Texts that mark an answer as left unfilled.
PLACEHOLDERS = ("[your comprehensive", "[your answer", "your comprehensive, professional")
PLACEHOLDER_WHOLE = "<your answer>"


def explicit_files(files: Column) -> Column:
    """Attachments that were chosen by hand (not the whole repository)."""
    return F.filter(F.coalesce(files, F.array()), lambda f: ~F.coalesce(f["is_repository"], F.lit(False)))


def flow_type(files: Column, rag: Column) -> Column:
    has = F.exists(
        F.coalesce(files, F.array()), lambda f: ~F.coalesce(f["is_repository"], F.lit(False))
    )
    return (
        F.when(has & rag, F.lit(FLOWS[True, True]))
        .when(has, F.lit(FLOWS[True, False]))
        .when(rag, F.lit(FLOWS[False, True]))
        .otherwise(F.lit(FLOWS[False, False]))
    )


def render_first(template: Column, values: dict[str, Column]) -> Column:
    """Fill each ``{key}`` once, at its first occurrence, in the given order."""
    out = template
    for key, value in values.items():
        mark = "{" + key + "}"
        at = F.locate(mark, out)
        out = F.when(at > 0, F.overlay(out, value, at, F.lit(len(mark)))).otherwise(out)
    return out


def render_fragment(template: Column, index: Column, path: Column, distance: Column, content: Column) -> Column:
    return render_first(
        template, {"index": index.cast("string"), "path": path, "distance": distance, "content": content}
    )


def render_file(template: Column, name: Column, kind: Column, ext: Column, content: Column) -> Column:
    return render_first(template, {"name": name, "type": kind, "extension": ext, "content": content})


def render_query_label(template: Column, prompt: Column) -> Column:
    return render_first(template, {"prompt": prompt})


def render_mode(header: Column, scope: Column, instruction: Column) -> Column:
    return F.concat(header, F.lit("\n"), scope, F.lit("\nInstruction: "), instruction, F.lit("\n</execution_mode>"))


def render_prompt(template: Column, user_query: Column, target_files: Column) -> Column:
    """Fill every ``{{user_query}}`` and then every ``{{target_files}}``."""
    asked = F.replace(template, F.lit("{{user_query}}"), user_query)
    return F.replace(asked, F.lit("{{target_files}}"), F.coalesce(target_files, F.lit("")))


def target_files_payload(files: Column) -> Column:
    def block(f):
        ext = attached_extension(f["name"])
        return F.concat_ws(
            "\n",
            F.concat(F.lit("File: "), xml_escape(f["name"])),
            F.concat(F.lit("Type: "), file_type_attached(f["name"])),
            F.concat(F.lit("Extension: "), F.when(ext == "", F.lit("no extension")).otherwise(xml_escape(ext))),
            F.lit(FENCE),
            xml_escape(strip_control(f["content"])),
            F.lit(FENCE),
        )

    return F.array_join(F.transform(explicit_files(files), block), "\n\n")


def flow_prompt(template: Column, flow: Column, user_query: Column, files: Column) -> Column:
    """User prompt of a flow; only the two attached-file flows see the files."""
    attached = flow.isin(FLOWS[True, True], FLOWS[True, False])
    return render_prompt(
        template, user_query, F.when(attached, target_files_payload(files)).otherwise(F.lit(""))
    )


def attached_block(f: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.lit("<attached_file>"),
        F.concat(F.lit("<name>"), xml_escape(f["name"]), F.lit("</name>")),
        F.lit("<content>"),
        xml_escape(strip_control(f["content"])),
        F.lit("</content>"),
        F.lit("</attached_file>"),
    )


def history_user_content(text: Column, active_files: Column) -> Column:
    asked = F.concat(F.lit("User instruction:\n"), F.coalesce(text, F.lit("")))
    blocks = F.array_join(F.transform(F.coalesce(active_files, F.array()), attached_block), "\n\n")
    return F.when(F.size(F.coalesce(active_files, F.array())) == 0, asked).otherwise(
        F.concat(blocks, F.lit("\n\n"), asked)
    )


def file_base(f: Column) -> Column:
    return base_name(f["name"])


# ---- agent replies -------------------------------------------------------


def final_answer(text: Column) -> Column:
    """What follows the first ``Final Answer:``; null when nothing does."""
    tail = js_trim(F.regexp_extract(text, r"(?is)final answer:(.*)\z", 1))
    return F.when(tail != "", tail)


def is_placeholder(answer: Column) -> Column:
    plain = F.lower(js_trim(F.coalesce(answer, F.lit(""))))
    hit = (plain == "") | (plain == PLACEHOLDER_WHOLE)
    for phrase in PLACEHOLDERS:
        hit = hit | F.contains(plain, F.lit(phrase))
    return hit


def action_query(text: Column) -> Column:
    """Argument of the first action line; null when it is empty or there is none."""
    pattern = r"(?i)^action:\s*[a-z_]*search\s*\((.*)\)\z"
    lines = F.transform(F.split(text, r"\r?\n"), js_trim)
    first = F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0))
    raw = js_trim(F.regexp_extract(first, pattern, 1))
    quoted = (F.length(raw) >= 2) & (
        (F.startswith(raw, F.lit('"')) & F.endswith(raw, F.lit('"')))
        | (F.startswith(raw, F.lit("'")) & F.endswith(raw, F.lit("'")))
    )
    bare = F.when(quoted, js_trim(F.substr(raw, F.lit(2), F.length(raw) - 2))).otherwise(raw)
    return F.when(first.isNotNull() & (bare != ""), bare)


def observation_text(query: Column, hits: Column, options) -> Column:
    """Tool report. ``hits`` is an ordered array of structs (path, content)."""
    head = F.concat(F.lit(f"Tool: {options.tool_name}\nQuery: "), query)

    def block(hit, i):
        return F.concat_ws(
            "\n",
            F.concat(F.lit("Result "), (i + 1).cast("string"), F.lit(" | Source: "), hit["path"]),
            F.lit(FENCE),
            hit["content"],
            F.lit(FENCE),
        )

    found = F.concat(head, F.lit("\n\n"), F.array_join(F.transform(hits, block), "\n"))
    return F.when(F.size(F.coalesce(hits, F.array())) == 0, F.concat(head, F.lit("\n" + options.no_match))).otherwise(
        found
    )


def repeated_text(query: Column, options) -> Column:
    return F.concat(F.lit(f"Tool: {options.tool_name}\nQuery: "), query, F.lit("\n" + options.repeated))


def continuation(observation: Column, options) -> Column:
    return F.concat(F.lit("Observation:\n"), observation, F.lit("\n\n" + options.keep_going))
