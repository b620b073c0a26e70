"""Fixed display values of known columns: key -> (label, type)."""

SALES_LABELS = {
    "id_mutation": ("Identifiant de mutation", "text"),
    "date_mutation": ("Date de mutation", "date"),
    "numero_disposition": ("Numéro de disposition", "text"),
    "nature_mutation": ("Nature de mutation", "text"),
    "valeur_fonciere": ("Valeur foncière", "number"),
    "adresse_numero": ("Numéro de voie", "text"),
    "adresse_suffixe": ("Suffixe de voie", "text"),
    "adresse_nom_voie": ("Nom de voie", "text"),
    "adresse_code_voie": ("Code voie", "text"),
    "code_postal": ("Code postal", "text"),
    "code_commune": ("Code commune", "text"),
    "nom_commune": ("Commune", "text"),
    "code_departement": ("Code département", "text"),
    "ancien_code_commune": ("Ancien code commune", "text"),
    "ancien_nom_commune": ("Ancien nom commune", "text"),
    "id_parcelle": ("Identifiant de parcelle", "text"),
    "ancien_id_parcelle": ("Ancien identifiant de parcelle", "text"),
    "numero_volume": ("Numéro de volume", "text"),
    "lot1_numero": ("Lot 1", "text"),
    "lot2_numero": ("Lot 2", "text"),
    "lot3_numero": ("Lot 3", "text"),
    "lot4_numero": ("Lot 4", "text"),
    "lot5_numero": ("Lot 5", "text"),
    "lot1_surface_carrez": ("Surface Carrez lot 1", "number"),
    "lot2_surface_carrez": ("Surface Carrez lot 2", "number"),
    "lot3_surface_carrez": ("Surface Carrez lot 3", "number"),
    "lot4_surface_carrez": ("Surface Carrez lot 4", "number"),
    "lot5_surface_carrez": ("Surface Carrez lot 5", "number"),
    "nombre_lots": ("Nombre de lots", "number"),
    "code_type_local": ("Code type de local", "text"),
    "type_local": ("Type de local", "text"),
    "surface_reelle_bati": ("Surface bâtie", "number"),
    "nombre_pieces_principales": ("Pièces principales", "number"),
    "code_nature_culture": ("Code nature de culture", "text"),
    "nature_culture": ("Nature de culture", "text"),
    "code_nature_culture_speciale": ("Code nature spéciale", "text"),
    "nature_culture_speciale": ("Nature spéciale", "text"),
    "surface_terrain": ("Surface terrain", "number"),
    "longitude": ("Longitude", "number"),
    "latitude": ("Latitude", "number"),
    "year": ("Millésime", "number"),
    "price_m2": ("Prix au m²", "number"),
}

INCOME_LABELS = {
    "year": ("Millésime", "number"),
    "geography_level": ("Maille", "text"),
    "commune_code": ("Code commune", "text"),
    "department_code": ("Code département", "text"),
    "commune_name": ("Commune", "text"),
    "source_generation": ("Génération source", "text"),
    "dispositif": ("Dispositif", "text"),
    "source_type": ("Type de source", "text"),
    "source_file": ("Fichier source", "text"),
    "extracted_file": ("Fichier extrait", "text"),
    "geo_object": ("Objet géographique", "text"),
    "median_income": ("Revenu médian", "number"),
    "d1_income": ("Décile D1", "number"),
    "d2_income": ("Décile D2", "number"),
    "d3_income": ("Décile D3", "number"),
    "d4_income": ("Décile D4", "number"),
    "d5_income": ("Médiane", "number"),
    "d6_income": ("Décile D6", "number"),
    "d7_income": ("Décile D7", "number"),
    "d8_income": ("Décile D8", "number"),
    "d9_income": ("Décile D9", "number"),
    "poverty_rate": ("Taux de pauvreté", "number"),
    "tax_households": ("Ménages fiscaux", "number"),
    "population": ("Population", "number"),
}

RESULT_LABELS = {
    "geographyCode": ("Code", "text"),
    "geographyName": ("Libellé", "text"),
    "indicatorValue": ("Valeur", "number"),
    "indicatorSource": ("Source", "text"),
    "isOfficial": ("Officiel", "boolean"),
    "methodologyVersion": ("Version méthodologique", "text"),
    "comparableWithPreviousYears": ("Comparable aux années précédentes", "boolean"),
}

FILTER_KINDS = {"number": "number-range", "date": "date-range", "boolean": "boolean-select", "text": "text"}
