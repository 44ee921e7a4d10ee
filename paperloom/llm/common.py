"""Shared helpers of the training-data operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession

#: Models and small tables above this many pickled bytes are refused as broadcasts; every caller states its own bound.
BROADCAST_LIMIT = 64 << 20


def checked_broadcast(spark: SparkSession, value: Any, limit: int = BROADCAST_LIMIT):
    """Broadcast a value after measuring its pickled size."""
    size = len(pickle.dumps(value, protocol=4))
    if size > limit:
        raise ValueError(f"{size} bytes to broadcast; the bound is {limit}")
    return spark.sparkContext.broadcast(value)


def skip_empty(f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """f without its frames of no rows, whose columns have no type."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in f(batches):
            if len(pdf):
                yield pdf

    return call


# Frequent function words of the seven languages of the corpora.
FUNCTION_WORDS = {
    "en": "the of and to in is was for be that with by has on at are or from this under which been not as its a an have were after will shall",
    "de": "der die das und ist wurde in den für mit dem im zu ob nicht von ein eine einer auf werden sich aus als an bei noch des es wird dass über sind nach war nur seit am bis wie",
    "fr": "le la les de des est du un une et que en à au dans pour par sur ne pas se si ce été soit il qui sont avec a d'un d'une n'a qu'il l'a plus aux ou sans",
    "es": "el la los las de del se por no que en un una y es para con fue sea si al su lo como más según o ha este esta sin han son otra sigue desde hace",
    "it": "il lo la i gli le di che non per è una un del della dei delle da si se nel alla al con sia ha in e sono resta a più gli degli dal nella questo come dalla ma stato",
    "nl": "de het een van op te zijn werd niet dat is in en voor aan met of als bij er nog tot wordt om die door aan ten ook naar sinds",
    "pt": "o a os as do da em não foi que para com um uma e é no na se ao dos das por mais seja de até ou ser pelo como nos foram à às sem sua",
}
