"""Stop-word lists. The short French list stands here; longer lists are parameters."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The Snowball list for French.
FRENCH = (
    "au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous "
    "on ou par pas pour qu que qui sa se ses sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y étée étées "
    "étant suis es êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était étions "
    "étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses fussions fussiez fussent ayant eu "
    "eue eues eus ai avons avez ont aurai aurons aurez auront aurais aurait aurions auriez auraient avais avait aviez avaient "
    "eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez eussent ceci cela celà cet cette "
    "ici ils les leurs quel quels quelle quelles sans soi"
).split()

_SPARK_NAMES = {"en": "english", "de": "german", "it": "italian", "pt": "portuguese", "es": "spanish"}


def load(spark: SparkSession, path: str) -> list[str]:
    """Words of a file, one a line; what follows '|' is a comment (the published list format)."""
    lines = (r.value.split("|")[0].split() for r in spark.read.text(path).toLocalIterator())
    return list(dict.fromkeys(w for words in lines for w in words))


def stop_words(spark: SparkSession, language: str, path: str | None = None) -> list[str]:
    """The list of a language: from path if given, else the French list here or the list that
    Spark brings for en, de, it, pt, es (its English list is shorter than some others' 318 words)."""
    if path:
        return load(spark, path)
    if language == "fr":
        return FRENCH
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(_SPARK_NAMES[language])
