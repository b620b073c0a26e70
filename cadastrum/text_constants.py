"""Fixed text values that must equal the published ones for right results."""

# Damaged sequence -> intended character, applied in this order.
MOJIBAKE = (
    ("â€™", "’"),
    ("â€˜", "‘"),
    ("â€œ", "“"),
    ("â€\u009d", "”"),
    ("â€¦", "…"),
    ("â€“", "–"),
    ("â€”", "—"),
    ("â†‘", "↑"),
    ("â†“", "↓"),
    ("â‚¬", "€"),
    ("Â²", "²"),
    ("Â·", "·"),
    ("Ã€", "À"),
    ("Ã‚", "Â"),
    ("Ã„", "Ä"),
    ("Ã‡", "Ç"),
    ("Ãˆ", "È"),
    ("Ã‰", "É"),
    ("ÃŠ", "Ê"),
    ("Ã‹", "Ë"),
    ("ÃŽ", "Î"),
    ("ÃÏ", "Ï"),
    ("Ã”", "Ô"),
    ("Ã–", "Ö"),
    ("Ã™", "Ù"),
    ("Ã›", "Û"),
    ("Ãœ", "Ü"),
    ("Ã\u00a0", "à"),
    ("Ã¢", "â"),
    ("Ã¤", "ä"),
    ("Ã§", "ç"),
    ("Ã¨", "è"),
    ("Ã©", "é"),
    ("Ãª", "ê"),
    ("Ã«", "ë"),
    ("Ã®", "î"),
    ("Ã¯", "ï"),
    ("Ã´", "ô"),
    ("Ã¶", "ö"),
    ("Ã¹", "ù"),
    ("Ã»", "û"),
    ("Ã¼", "ü"),
)

# Unaccented French word (whole word, any case) -> display form, in this order.
UNACCENTED_WORDS = (
    ("departement", "département"),
    ("departements", "départements"),
    ("fonciere", "foncière"),
    ("foncieres", "foncières"),
    ("numero", "numéro"),
    ("bati", "bâti"),
    ("batir", "bâtir"),
    ("agrement", "agrément"),
    ("metadonnees", "métadonnées"),
    ("apercu", "aperçu"),
    ("selectionne", "sélectionné"),
    ("libelle", "libellé"),
    ("annee", "année"),
    ("annees", "années"),
    ("reference", "référence"),
    ("resume", "résumé"),
)

PHRASES = (("terrains a bâtir", "terrains à bâtir"),)

# Tokens a boolean filter understands.
TRUE_TOKENS = ("true", "1", "yes", "oui", "vrai")
FALSE_TOKENS = ("false", "0", "no", "non", "faux")
