"""Chat exports: web chats, node graphs, messengers. Each reader gives (session_id, title, turn_index, role, text, occurred_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim

WEB = "array<struct<uuid:string,name:string,created_at:string,updated_at:string,chat_messages:array<struct<sender:string,text:string,created_at:string>>>>"
NODE = (
    "struct<id:string,parent:string,message:struct<author:struct<role:string>,create_time:double,content:struct<parts:array<string>>,"
    "metadata:struct<is_visually_hidden_from_conversation:boolean>>>"
)
GRAPH = f"array<struct<conversation_id:string,id:string,title:string,create_time:double,update_time:double,current_node:string,mapping:map<string,{NODE}>>>"
MESSENGER = "struct<name:string,type:string,id:string,messages:array<struct<id:string,type:string,date:string,from:string,text:string>>>"
_TURN = "struct<role:string,text:string,occurred_at:string>"


def _numbered(conversations: DataFrame, session: Column, title: Column, turns: Column) -> DataFrame:
    """Turns without text drop out; the rest are numbered from 0."""
    kept = F.filter(turns, lambda t: F.coalesce(F.length(t["text"]), F.lit(0)) > 0)
    rows = conversations.select(session.alias("session_id"), title.alias("title"), F.posexplode(kept).alias("turn_index", "t"))
    return rows.select("session_id", "title", "turn_index", "t.role", "t.text", "t.occurred_at")


def _turn(role: Column, text: Column, at: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"), at.alias("occurred_at")).cast(_TURN)


def web_chats(exports: DataFrame, json: str = "json") -> DataFrame:
    """One JSON array of conversations a row; those without an id or messages are left out."""
    c = exports.select(F.explode(F.from_json(json, WEB)).alias("c")).select("c.*").filter(F.col("uuid").isNotNull() & (F.coalesce(F.size("chat_messages"), F.lit(0)) > 0))
    turns = F.transform("chat_messages", lambda m: _turn(F.when(m["sender"] == "human", "user").otherwise("assistant"), trim(m["text"]), F.coalesce(m["created_at"], F.col("created_at"))))
    return _numbered(c, F.col("uuid"), F.col("name"), turns)


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_millis((seconds * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def linearize(mapping: Column, current: Column) -> Column:
    """The nodes from the root to the current one; without a usable current node, all messages by time.

    The walk takes at most as many steps as there are nodes, so a cycle ends it.
    """
    steps = F.transform(F.map_keys(mapping), lambda k: k)
    start = F.struct(current.alias("at"), F.array().cast("array<string>").alias("path"))

    def step(acc: Column, _: Column) -> Column:
        node = F.element_at(mapping, acc["at"])
        stop = acc["at"].isNull() | node.isNull() | F.array_contains(acc["path"], acc["at"])
        return F.when(stop, F.struct(F.lit(None).cast("string").alias("at"), acc["path"].alias("path"))).otherwise(F.struct(node["parent"].alias("at"), F.concat(acc["path"], F.array(acc["at"])).alias("path")))

    path = F.transform(F.reverse(F.aggregate(steps, start, step)["path"]), lambda k: F.element_at(mapping, k))
    with_message = F.filter(F.map_values(mapping), lambda n: n["message"].isNotNull())
    by_time = F.array_sort(F.transform(with_message, lambda n: F.struct(F.coalesce(n["message"]["create_time"], F.lit(0.0)).alias("t"), n["id"].alias("id"), n.alias("n"))))
    usable = current.isNotNull() & F.element_at(mapping, current).isNotNull()
    return F.when(usable, path).otherwise(F.transform(by_time, lambda s: s["n"]))


def node_text(node: Column) -> Column:
    """A visible user's or assistant's text parts, joined by line feeds; else null."""
    m = node["message"]
    shown = m["author"]["role"].isin("user", "assistant") & ~F.coalesce(m["metadata"]["is_visually_hidden_from_conversation"], F.lit(False))
    # A part that isn't a string comes as JSON text of an object.
    parts = F.filter(m["content"]["parts"], lambda p: ~F.coalesce(p.rlike(r"\A\{.*\}\z"), F.lit(True)))
    return F.when(shown, F.nullif(trim(F.array_join(parts, "\n")), F.lit("")))


def graph_chats(exports: DataFrame, json: str = "json") -> DataFrame:
    c = exports.select(F.explode(F.from_json(json, GRAPH)).alias("c")).select("c.*").filter(F.coalesce("conversation_id", "id").isNotNull())
    nodes = linearize(F.col("mapping"), F.col("current_node"))
    turns = F.transform(nodes, lambda n: _turn(n["message"]["author"]["role"], node_text(n), iso_time(F.coalesce(n["message"]["create_time"], F.col("create_time")))))
    return _numbered(c, F.coalesce("conversation_id", "id"), F.col("title"), turns)


def flat_text(text: Column) -> Column:
    """Rich text: a string, or an array of strings and of objects with a text, joined."""
    parts = F.from_json(text, "array<string>")
    one = lambda p: F.coalesce(F.when(p.rlike(r"\A\{"), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p), F.lit(""))
    return F.when(text.rlike(r"\A\["), F.array_join(F.transform(parts, one), "")).otherwise(F.coalesce(text, F.lit("")))


def messenger_chats(exports: DataFrame, json: str = "json", folder: str | None = None) -> DataFrame:
    """One chat's JSON object a row; the chat's own name speaks as the assistant."""
    c = exports.select(F.from_json(json, MESSENGER).alias("c"), F.col(folder).alias("_folder") if folder else F.lit(None).cast("string").alias("_folder")).select("c.*", "_folder")
    messages = F.filter("messages", lambda m: m["type"] == "message")
    turns = F.transform(messages, lambda m: _turn(F.when(m["from"].isNotNull() & (m["from"] != "") & (m["from"] == F.col("name")), "assistant").otherwise("user"), trim(flat_text(m["text"])), m["date"]))
    return _numbered(c, F.concat(F.lit("telegram-"), F.coalesce("id", "_folder")), F.col("name"), turns)
