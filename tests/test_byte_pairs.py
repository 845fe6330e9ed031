import os
import socket
from multiprocessing.connection import Client, Listener

import numpy as np
from pyspark.sql import functions as F

from quern.functions import syllable
from quern.operators import bpe, count


def test_parsing_asks_only_words_of_a_syllables_shape(spark):
    """All that parses has the shape, in whatever case; what hasn't is kept without the parser's work, with the same result."""
    lex = count.lexicon(spark).select(F.col("text").alias("token"))
    odd = ["", "h", "nghiêngh", "strength", "aaaaaa", "x1", "a-b", "giuyêu", "họ\u0323", "\U0001f4a5", "ngoằnnn", "Ω", None]
    words = lex.union(lex.select(F.upper("token"))).union(lex.select(F.concat("token", F.lit("h")))).union(lex.select(F.concat(F.lit("t"), "token"))).union(spark.createDataFrame([(w,) for w in odd], "token string"))
    words = words.withColumn("cnt", F.lit(1).cast("long"))
    parsed = count.parsed(words)
    shaped = f"octet_length(token) <= 9 and token rlike '{syllable.SHAPE}'"
    assert parsed.filter(f"can_be_vietnamese and not ({shaped})").count() == 0
    assert words.filter(shaped).count() < words.count()
    kept = parsed.filter("not can_be_vietnamese").select("token", "cnt")
    assert count.unparsed(words).exceptAll(kept).count() == kept.exceptAll(count.unparsed(words)).count() == 0


def test_tasks_that_learn_together_send_at_once():
    """Large messages don't wait for the receiver's delayed acknowledgement of their lengths."""
    with Listener(("127.0.0.1", 0)) as here:
        there = bpe._prompt(Client(here.address))
        with there, bpe._prompt(here.accept()) as other:
            for x in (there, other):
                with socket.socket(fileno=os.dup(x.fileno())) as s:
                    assert s.getsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY)
            there.send(list(range(10_000)))
            assert other.recv() == list(range(10_000))


def test_changes_of_all_shards_count_together():
    """A symbol beside a merged pair in several shards is counted once, with the sum."""
    one, two = (np.array([97, 98]), np.array([3, 1])), (np.array([98]), np.array([4]))
    assert bpe._summed((one[0], two[0]), (one[1], two[1])) == ([97, 98], [3, 5])
    assert bpe._summed((two[0],), (two[1],)) == ([98], [4])
