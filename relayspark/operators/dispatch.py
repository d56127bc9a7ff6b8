"""Typed message dispatch: frames to a handler's name and arguments, by explicit rules and a whitelist."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How each kind of channel treats a message: lower-case its type, keep the type among the arguments, read
#: type and data from a JSON envelope; and what an empty, a reserved and an unknown type lead to.
CHANNELS: Mapping[str, dict] = {
    "router": {"lower": True, "keep": False, "envelope": False, "empty": "error", "reserved": "error", "unknown": "unhandled"},
    "dealer": {"lower": True, "keep": True, "envelope": False, "empty": "unhandled", "reserved": "raise", "unknown": "unhandled"},
    "request": {"lower": False, "keep": False, "envelope": True, "empty": "unhandled", "reserved": "raise", "unknown": "unhandled"},
    "pull": {"lower": False, "keep": False, "envelope": False, "empty": "error", "reserved": "raise", "unknown": "error"},
    "pub": {"lower": False, "keep": False, "envelope": False, "empty": "error", "reserved": "raise", "unknown": "error"},
    "logger": {"lower": False, "keep": False, "envelope": False, "empty": "error", "reserved": "raise", "unknown": "error"},
}


def frame(frames: Column, index: int) -> Column:
    """A frame by 0-based index; negative ones count from the end. Null if there is none."""
    return F.try_element_at(frames, F.lit(index + 1 if index >= 0 else index))


def without(frames: Column, index: int) -> Column:
    """The frames but the one at ``index``."""
    place = F.lit(index) if index >= 0 else F.size(frames) + index
    return F.filter(frames, lambda _, i: i != place)


def dispatch(messages: DataFrame, handlers: list[str], channel: str = "router", index: int = 1) -> DataFrame:
    """``messages`` (with ``frames``) plus ``msg_type``, ``args``, ``handler`` and ``problem``.

    ``handler`` is a name of ``handlers``, or ``error``, ``raise`` or ``unhandled`` as the channel has it;
    ``problem`` says why. The type is never used to look up code.
    """
    rule = CHANNELS[channel]
    raw = F.decode(frame(F.col("frames"), index), "UTF-8")
    if rule["envelope"]:
        pair = F.from_json(raw, "array<string>")
        kind, args = F.get(pair, F.lit(0)), F.transform("frames", lambda f, i: F.when(i == (F.lit(index) if index >= 0 else F.size("frames") + index), F.encode(F.get(pair, F.lit(1)), "UTF-8")).otherwise(f))
    else:
        kind, args = raw, F.col("frames") if rule["keep"] else without(F.col("frames"), index)
    kind = F.lower(kind) if rule["lower"] else kind
    out = messages.withColumn("msg_type", kind).withColumn("args", args)
    known = F.col("msg_type").isin(handlers)
    empty = F.coalesce(F.col("msg_type"), F.lit("")) == ""
    reserved = F.col("msg_type").startswith("_")
    out = out.withColumn("handler", F.when(empty, rule["empty"]).when(reserved, rule["reserved"]).when(known, F.col("msg_type")).otherwise(rule["unknown"]))
    said = F.when(empty, "Message is empty.").when(reserved, F.concat("msg_type", F.lit(' starts with an "_"'))).when(~known, F.concat(F.lit("no handler for "), "msg_type"))
    return out.withColumn("problem", said)


def rejects(dispatched: DataFrame) -> DataFrame:
    """Messages that no handler takes."""
    return dispatched.where(F.col("problem").isNotNull())


class Handlers:
    """A whitelist of message types, each with a function from its messages to a DataFrame."""

    def __init__(self):
        self.known: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def on(self, msg_type: str):
        """Decorator: handle messages of ``msg_type``."""
        if not msg_type or msg_type.startswith("_"):
            raise ValueError("a message type is not empty and has no leading underscore")

        def put(handler: Callable[[DataFrame], DataFrame]):
            self.known[msg_type] = handler
            return handler

        return put

    def ignore(self, *msg_types: str) -> None:
        """Take messages of these types and do nothing with them: they are no rejects."""
        for name in msg_types:
            self.on(name)(lambda messages: messages.where("false"))

    def run(self, messages: DataFrame, channel: str = "router", index: int = 1) -> dict[str, DataFrame]:
        """The result of each handler, and ``rejects``."""
        routed = dispatch(messages, sorted(self.known), channel, index)
        results = {name: handler(routed.where(F.col("handler") == name)) for name, handler in self.known.items()}
        return results | {"rejects": rejects(routed)}


def exchange(messages: DataFrame, identity: str = "recipient") -> DataFrame:
    """Messages dealt out by the identity they are addressed to, so that all of one recipient meet in one task. A
    recipient of a large part of all messages makes one large task; aggregate before, where that will do."""
    return messages.repartition(identity)


def status(messages: DataFrame) -> DataFrame:
    """(sender, line) of status and error messages: what their handlers print."""
    last = F.decode(F.element_at("frames", -1), "UTF-8")
    said = F.concat(F.lit("Received message from "), F.decode(F.get("frames", F.lit(0)), "UTF-8"), F.lit(", with error: "), last, F.lit("!"))
    return messages.where(F.size("frames") > 0).select("sender", said.alias("line"))


def strict(dispatched: DataFrame) -> DataFrame:
    """The same rows; a message that its channel would raise for fails the query with its problem."""
    checked = F.when(F.col("handler") == "raise", F.raise_error(F.col("problem")).cast("string")).otherwise(F.col("handler"))
    return dispatched.withColumn("handler", checked)


def reply(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Each answer (sender, request_id, ...) to the sender and request that asked for it; requests without an answer
    give no row."""
    return requests.select("sender", "request_id").join(answers, ["sender", "request_id"])


def answer(requests: DataFrame, text: str) -> DataFrame:
    """The same ``text`` to every request (sender, request_id)."""
    return requests.select("sender", "request_id", F.lit(text).alias("reply"))


def pong(requests: DataFrame) -> DataFrame:
    return answer(requests, "Pong")


def reintroduced(requests: DataFrame) -> DataFrame:
    """What a client hears once the registry has been broadcast."""
    return answer(requests, "Done reintroducing...")
