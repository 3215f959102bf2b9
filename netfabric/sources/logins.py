"""Login records of sshd, which two feeds carry, taken apart word by word."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from netfabric.sources.syslog import port


class Login(NamedTuple):
    """``matched`` is false, and the rest NULL, where the message has another form."""

    matched: Column
    user: Column
    address: Column
    port: Column
    unknown_user: Column


def sshd_login(message: Column, verdict: str, method: str | None = None) -> Login:
    """``<verdict> <method> for [invalid user] <user> from <address> port <port> ...``."""
    words = F.split(message, " ")
    unknown = (F.get(words, F.lit(3)) == "invalid") & (F.get(words, F.lit(4)) == "user") & (F.get(words, F.lit(5)) != "from")
    start = F.when(unknown, 5).otherwise(3)
    word = lambda offset: F.get(words, start + offset)
    number = port(word(4))
    matched = (
        (F.get(words, F.lit(0)) == verdict) & (F.get(words, F.lit(2)) == "for") & (word(1) == "from") & (word(3) == "port")
        & (word(0) != "") & (word(2) != "") & number.isNotNull()
    )
    if method is not None:
        matched = matched & (F.get(words, F.lit(1)) == method)
    matched = F.coalesce(matched, F.lit(False))
    taken = lambda value: F.when(matched, value)
    return Login(matched, taken(word(0)), taken(word(2)), taken(number), matched & unknown)


def word_after(message: Column, mark: str) -> Column:
    """The characters between a mark and the next blank; NULL where there are none."""
    return F.nullif(F.split_part(F.split_part(message, F.lit(mark), F.lit(2)), F.lit(" "), F.lit(1)), F.lit(""))
