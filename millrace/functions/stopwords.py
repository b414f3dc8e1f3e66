"""Closed-class words of French and English, for language scores and retrieval. The two lists are disjoint."""

FRENCH = frozenset(
    "le la les un une des du de au aux et ou mais donc car ni que qui quoi dont où ce cet cette ces mon ma mes ton ta tes son sa ses notre nos votre vos leur leurs "
    "je tu il elle nous vous ils elles se lui eux y en ne pas plus par pour avec sans sous sur dans chez vers entre est sont était étaient être avoir ont avait "
    "avaient sera seront fait faire comme si très bien aussi ainsi alors après avant depuis pendant encore toujours jamais tout tous toute toutes même".split()
)
ENGLISH = frozenset(
    "the an and or but nor of to from with without by at into onto over under for in is are was were be been being am has have had do does did not no this that these "
    "those it its he she they them his her hers their theirs we us our ours you your yours who whom whose which what where when why how all any some each every both "
    "few more most other than then there here so too very can could will would shall should may might must as if because while about".split()
)
assert not FRENCH & ENGLISH
LANGUAGES = {"fr": FRENCH, "en": ENGLISH}
