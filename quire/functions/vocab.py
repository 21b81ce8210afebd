"""Fixed values.

The lists below are data that results depend on (search vocabulary, statuses, stop
words, publishers).  They are stated plainly, in natural order.
"""

# --- fixed values: acronyms and their expansions -------------------------------------
ACRONYMS: dict[str, list[str]] = {
    "ald": ["atomic layer deposition"],
    "cvd": ["chemical vapor deposition"],
    "pvd": ["physical vapor deposition"],
    "mald": ["molecular atomic layer deposition"],
    "mocvd": ["metal organic chemical vapor deposition"],
    "pecvd": ["plasma enhanced chemical vapor deposition"],
    "euv": ["extreme ultraviolet", "EUV lithography"],
    "duv": ["deep ultraviolet"],
    "xps": ["x-ray photoelectron spectroscopy"],
    "xrd": ["x-ray diffraction"],
    "sem": ["scanning electron microscopy", "scanning electron microscope"],
    "tem": ["transmission electron microscopy"],
    "afm": ["atomic force microscopy"],
    "ftir": ["fourier transform infrared"],
    "uv": ["ultraviolet"],
    "ir": ["infrared"],
    "ml": ["machine learning"],
    "dl": ["deep learning"],
    "nn": ["neural network", "neural networks"],
    "cnn": ["convolutional neural network"],
    "rnn": ["recurrent neural network"],
    "dft": ["density functional theory"],
    "md": ["molecular dynamics"],
    "mos": ["metal oxide semiconductor"],
    "cmos": ["complementary metal oxide semiconductor"],
    "fet": ["field effect transistor"],
    "mosfet": ["metal oxide semiconductor field effect transistor"],
    "led": ["light emitting diode"],
    "oled": ["organic light emitting diode"],
    "pv": ["photovoltaic", "photovoltaics"],
    "ree": ["rare earth elements"],
    "hte": ["high throughput experimentation"],
    "doe": ["design of experiments"],
}

# --- fixed values: domain synonyms ---------------------------------------------------
SYNONYMS: dict[str, list[str]] = {
    "film": ["layer", "coating", "thin film"],
    "layer": ["film", "coating"],
    "coating": ["film", "layer", "deposition"],
    "deposition": ["growth", "coating", "synthesis"],
    "growth": ["deposition", "synthesis", "formation"],
    "synthesis": ["preparation", "fabrication", "growth"],
    "fabrication": ["synthesis", "manufacturing", "processing"],
    "etching": ["removal", "patterning"],
    "patterning": ["lithography", "etching"],
    "substrate": ["wafer", "support"],
    "wafer": ["substrate"],
    "precursor": ["reactant", "source"],
    "catalyst": ["catalytic"],
    "membrane": ["film", "barrier"],
    "nanoparticle": ["nanoparticles", "NP", "NPs"],
    "nanomaterial": ["nanomaterials"],
    "photoresist": ["resist", "photo-resist"],
    "resist": ["photoresist"],
}

# --- fixed values: publishers by DOI prefix ------------------------------------------
PUBLISHERS: dict[str, str] = {
    "10.1016": "Elsevier",
    "10.1021": "ACS Publications",
    "10.1002": "Wiley",
    "10.1038": "Nature",
    "10.1007": "Springer",
    "10.1039": "RSC",
    "10.1088": "IOP Publishing",
    "10.1063": "AIP Publishing",
    "10.1080": "Taylor & Francis",
    "10.3390": "MDPI",
    "10.1109": "IEEE",
    "10.1371": "PLOS",
}

# --- fixed values: statuses ----------------------------------------------------------
READ_STATUSES = ["unread", "reading", "read", "skimmed"]
EXTRACTION_STATUSES = ["none", "abstract_only", "comprehensive"]
ENRICHMENT_STATUSES = [
    "pending", "needs_pdf", "needs_chunking", "needs_extraction",
    "needs_deep_extraction", "needs_review", "complete", "failed",
]
LEGACY_ENRICHMENT = {"needs_abstract": "needs_extraction", "needs_chunks": "needs_chunking"}

# --- fixed values: words skipped when a citation key is built ------------------------
KEY_SKIP_WORDS = ["a", "an", "the", "on", "of", "for", "in", "to"]
