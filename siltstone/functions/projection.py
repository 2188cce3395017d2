"""Transcript entries to text: content blocks, tool calls, roles, and marks of talk about the engine itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import AFTER, EDGE

#: The superset of all content blocks; a tool's input stays JSON.
BLOCK = "type string, text string, thinking string, id string, name string, input string, tool_use_id string, content string, is_error boolean"
ENTRY = (
    "type string, uuid string, id string, parentUuid string, parentId string, timestamp string, sessionId string, cwd string, gitBranch string, "
    "isSidechain boolean, isMeta boolean, summary string, aiTitle string, message struct<role: string, content: string>"
)
# The engine's own tools, and how much of each tool call is kept.
OWN_TOOLS = ["search_sessions", "search_memory", "search_all", "get_session", "replay_session", "list_sessions"]
RESULT_CHARS = 200


def one_liner(name: Column, tool_input: Column) -> Column:
    """A tool call in one line."""
    get = lambda key, missing="?": F.coalesce(F.get_json_object(tool_input, f"$.{key}"), F.lit(missing))
    line = lambda label, body: F.concat(F.lit(f"[{label}: "), body, F.lit("]"))
    return (
        F.when(name == "Read", line("Read", get("file_path")))
        .when(name == "Edit", line("Edit", F.concat(get("file_path"), F.lit(" ("), F.substring(get("old_string", ""), 1, 40), F.lit("...)"))))
        .when(name == "Write", line("Write", get("file_path")))
        .when(name == "Bash", line("Bash", F.substring(get("command", ""), 1, 60)))
        .when(name == "Task", line("Task", F.concat(F.lit('"'), F.substring(get("description", ""), 1, 50), F.lit('" → '), get("subagent_type", "general-purpose"))))
        .when(name == "Grep", line("Grep", get("pattern")))
        .when(name == "Glob", line("Glob", get("pattern")))
        .when(name == "WebFetch", line("WebFetch", F.substring(get("url"), 1, 60)))
        .when(name == "WebSearch", line("WebSearch", get("query")))
        .otherwise(F.concat(F.lit("["), name, F.lit("]")))
    )


def _is_array(json: Column) -> Column:
    return F.coalesce(json.rlike(r"\A\s*\["), F.lit(False))


def blocks(content: Column) -> Column:
    """The content blocks of a message whose content is an array; null for other content."""
    return F.when(_is_array(content), F.from_json(content, f"array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>"))


def block_text(block: Column) -> Column:
    """One block as text; null for images and unknown kinds."""
    inner = F.from_json(block["content"], "array<struct<type:string,text:string>>")
    parts = F.filter(F.transform(inner, lambda c: F.when(c["type"] == "text", c["text"])), lambda t: F.coalesce(t, F.lit("")) != "")
    body = F.when(_is_array(block["content"]), F.array_join(parts, "\n")).otherwise(F.coalesce(block["content"], F.lit("")))
    result = F.concat(F.when(F.coalesce(block["is_error"], F.lit(False)), "[Tool error] ").otherwise("[Tool result] "), F.substring(body, 1, RESULT_CHARS))
    return (
        F.when(block["type"] == "text", block["text"])
        .when(block["type"] == "thinking", F.concat(F.lit("[thinking] "), block["thinking"]))
        .when(block["type"] == "tool_use", one_liner(block["name"], block["input"]))
        .when(block["type"] == "tool_result", result)
    )


def message_text(content: Column) -> Column:
    """A message's text: a string as it is, blocks joined by line feeds."""
    lines = F.filter(F.transform(blocks(content), block_text), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.when(_is_array(content), F.array_join(lines, "\n")).otherwise(F.coalesce(content, F.lit("")))


def entry_text(entry_type: Column, content: Column, summary: Column) -> Column:
    """The text of an entry; null where its type bears none."""
    return F.when(entry_type.isin("user", "assistant"), message_text(content)).when(entry_type == "summary", F.concat(F.lit("[Compaction Summary] "), summary))


def entry_role(entry_type: Column) -> Column:
    return F.when(entry_type == "summary", "compaction").when(entry_type.isin("user", "assistant"), entry_type)


def tools_called(content: Column) -> Column:
    return F.coalesce(F.transform(F.filter(blocks(content), lambda b: b["type"] == "tool_use"), lambda b: b["name"]), F.array().cast("array<string>"))


def is_own_tool(name: Column, product: str) -> Column:
    return name.isin(OWN_TOOLS) | (name.startswith("mcp__") & F.lower(name).contains(product.lower()))


def uses_own_tool(entry_type: Column, content: Column, product: str) -> Column:
    return (entry_type == "assistant") & F.exists(tools_called(content), lambda t: is_own_tool(t, product))


def names_product(text: Column, product: str) -> Column:
    from .text import literal

    return F.coalesce(text.rlike(rf"(?i){EDGE}{literal(product)}{AFTER}"), F.lit(False))


def is_meta_message(entry_type: Column, content: Column, product: str) -> Column:
    return uses_own_tool(entry_type, content, product) | (entry_type.isin("user", "assistant") & names_product(message_text(content), product))
