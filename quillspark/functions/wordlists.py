"""Word lists that rules compare with."""

# Genera of microbes, plants and model organisms, lower-case.
GENERA = """
    escherichia salmonella staphylococcus streptococcus pseudomonas klebsiella
    bacillus lactobacillus clostridium mycobacterium enterococcus acinetobacter
    campylobacter helicobacter listeria shigella vibrio proteus serratia
    xanthomonas rhizobium azotobacter agrobacterium erwinia ralstonia
    saccharomyces candida aspergillus penicillium fusarium trichoderma rhizopus
    alternaria colletotrichum cryptococcus pichia rhodotorula mucor botrytis
    chlorella spirulina scenedesmus chlamydomonas nannochloropsis dunaliella
    arabidopsis oryza triticum zea hordeum sorghum glycine cicer vigna phaseolus
    pisum lens brassica gossypium helianthus arachis solanum capsicum lycopersicon
    cucumis cucurbita daucus allium spinacia lactuca aegilops avena secale
    musa mangifera citrus punica psidium carica ananas vitis malus prunus ficus
    phoenix cocos elaeis camellia coffea theobroma piper curcuma zingiber
    azadirachta ocimum withania asparagus tinospora terminalia emblica phyllanthus
    aloe cassia senna glycyrrhiza foeniculum trigonella coriandrum cuminum
    boerhavia sida rubia moringa holarrhena randia pluchea podophyllum berberis
    bryophyllum eichhornia pontederia acacia eucalyptus tectona dalbergia
    bambusa saccharum jatropha ricinus linum sesamum brassicaceae
    caenorhabditis drosophila danio mus rattus xenopus gallus bombyx apis
    anopheles aedes culex tribolium spodoptera helicoverpa nilaparvata
    homo pan macaca sus bos capra ovis canis felis oryctolagus
    eragrostis macrotyloma cyperus madhuca plectranthus centella bacopa
    datura atropa nicotiana physalis cestrum lycianthes petunia
    andrographis adhatoda gymnema momordica eclipta bauhinia
""".split()

# Species that are written with the genus abbreviated.
ABBREVIATED = (
    "e. coli", "s. aureus", "s. cerevisiae", "p. aeruginosa", "b. subtilis",
    "c. albicans", "k. pneumoniae", "s. typhi", "s. typhimurium", "l. monocytogenes",
    "h. pylori", "c. difficile", "m. tuberculosis", "a. niger", "a. flavus",
    "p. falciparum", "c. elegans", "d. melanogaster", "a. thaliana",
)

# American spellings and the British ones.
US_TO_UK = {
    "analyze": "analyse", "analyzed": "analysed", "analyzing": "analysing",
    "characterize": "characterise", "characterized": "characterised", "characterizing": "characterising", "characterization": "characterisation",
    "utilize": "utilise", "utilized": "utilised", "utilizing": "utilising", "utilization": "utilisation",
    "optimize": "optimise", "optimized": "optimised", "optimizing": "optimising", "optimization": "optimisation",
    "standardize": "standardise", "standardized": "standardised",
    "sterilize": "sterilise", "sterilized": "sterilised",
    "organize": "organise", "organized": "organised", "organization": "organisation",
    "recognize": "recognise", "recognized": "recognised",
    "minimize": "minimise", "minimized": "minimised",
    "maximize": "maximise", "maximized": "maximised",
    "summarize": "summarise", "summarized": "summarised",
    "emphasize": "emphasise", "emphasized": "emphasised",
    "stabilize": "stabilise", "stabilized": "stabilised",
    "polymerization": "polymerisation", "crystallization": "crystallisation",
    "color": "colour", "colors": "colours", "colored": "coloured", "colorless": "colourless",
    "behavior": "behaviour", "behaviors": "behaviours", "behavioral": "behavioural",
    "labor": "labour", "favor": "favour", "favorable": "favourable", "flavor": "flavour", "odor": "odour", "vapor": "vapour", "vapors": "vapours",
    "center": "centre", "centers": "centres", "centered": "centred", "fiber": "fibre", "fibers": "fibres", "liter": "litre", "liters": "litres",
    "aluminum": "aluminium", "sulfur": "sulphur", "sulfate": "sulphate", "sulfates": "sulphates", "sulfide": "sulphide", "sulfuric": "sulphuric",
    "modeling": "modelling", "modeled": "modelled", "labeling": "labelling", "labeled": "labelled",
    "catalog": "catalogue", "catalogs": "catalogues", "gray": "grey", "aging": "ageing",
}

# Words that a journal's name is compared without.
NAME_STOPS = ("the", "of", "and", "for", "in", "on", "a", "an", "to", "journal", "journals", "international", "research")

# Words that negate.
NEGATIONS = (
    "not", "no", "never", "cannot", "can't", "without", "neither", "nor", "none", "absent", "lack", "lacks", "lacked", "lacking",
    "fail", "fails", "failed", "failing", "failure", "failures", "unable", "insignificant", "nonsignificant", "non-significant",
)

# Prefixes that authors join with a hyphen.
PREFIXES = ("non", "pre", "post", "multi", "sub", "semi", "anti", "inter", "intra", "over", "under", "micro", "macro", "nano", "co", "self", "cross", "re")

# Words that are no half of a compound.
FUNCTION_WORDS = """
    a an the and or nor but if then than that this these those of in on at to for from by with within without into onto over under
    is are was were be been being has have had do does did not no as it its their his her our your my we they he she you i
    also such can could may might must shall should will would there here when where which who whom whose
""".split()

# Labels that open a caption, and verbs by which a sentence reports one.
CAPTION_LABELS = ("figure", "fig", "table", "tab", "scheme", "plate")
CENSUS_LABELS = ("figure", "fig", "table", "scheme", "equation", "eq")
REPORTING_VERBS = (
    "show", "summarise", "summarize", "present", "illustrate", "display", "list", "give", "depict", "compare", "indicate", "report", "describe", "reveal", "contain",
)

# Months and seasons that a date may name.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
SEASONS = ("Spring", "Summer", "Autumn", "Fall", "Winter")
