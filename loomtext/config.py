"""Constants of the engine; each operator takes them as parameters with these defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Quality:
    """The bounds of the mixing quality filter."""

    min_chars: int = 100
    min_words: int = 20
    min_unique: float = 0.3
    min_alpha: float = 0.6
    min_line: float = 20.0
    max_short_lines: int = 10


#: The special tokens of the trained tokenizer, at ids 256 to 263.
SPECIAL_TOKENS = ("<PAD>", "<UNK>", "<BOS>", "<EOS>", "<SEP>", "<USER>", "<ASST>", "<SYS>")
PAD, UNK, BOS, EOS, SEP, USER, ASST, SYS = range(256, 264)
VOCAB_SIZE = 32_000
#: How much an event of a log matters.
IMPORTANCE = {"info": 1, "learning": 1, "progress": 1, "milestone": 2, "checkpoint": 2, "warning": 2, "error": 3, "critical": 3, "session_end": 2}
#: Title prefixes of dump pages that are no articles.
SKIPPED_TITLES = (
    "Discussion:", "Utilisateur:", "Wikipédia:", "Fichier:", "MediaWiki:", "Modèle:", "Aide:", "Catégorie:", "Portail:", "Projet:", "Référence:",
    "Module:", "Talk:", "User:", "Wikipedia:", "File:", "Template:", "Help:", "Category:", "Portal:", "Draft:",
)
