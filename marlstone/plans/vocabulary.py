"""Fixed values of screening: word lists and patterns that decide what a text is about.

They are stated as they must be for right results and carry no logic.
"""

# ---- fixed values ----
TOPIC = [
    "biochar", "activated carbon", "acid-modified", "acid modified", "acid activation", "acid treatment", "acid-treated", "hcl", "h2so4", "hno3",
    "phosphoric acid", "citric acid", "heavy metal", "metal ion", "pb(ii)", "cd(ii)", "cu(ii)", "zn(ii)", "ni(ii)", "cr(vi)", "cr(iii)", "as(iii)", "as(v)",
    "hg(ii)", "u(vi)", "cs(i)", "sr(ii)", "co(ii)", "i⁻", "io₃⁻", "tco₄⁻", "th(iv)", "eu(iii)", "la(iii)", "ce(iii)", "reo₄⁻", "uranium", "cesium",
    "caesium", "strontium", "cobalt", "iodide", "iodate", "pertechnetate", "technetium", "thorium", "europium", "lanthanum", "cerium", "perrhenate", "rhenium",
]
ACID_REAGENTS = ["hcl", "h2so4", "hno3", "h3po4", "hydrochloric acid", "sulfuric acid", "nitric acid", "phosphoric acid", "citric acid", "oxalic acid", "acetic acid"]
ACID_MODIFIED = ["acid-modified", "acid modified", "acid activation", "acid treatment", "acid-treated", "acidified"]
BIOCHAR_PREPARATION = ["biochar", "pyrolysis", "feedstock", "biomass", "activation"]
METHOD = ["materials and methods", "experimental", "preparation", "pyrolysis", "activation", "acidification", "adsorbent"]
DATA = ["table", "langmuir", "freundlich", "kinetic", "pseudo-second-order", "surface area", "bet", "pore volume", "pH", "c0", "qe", "mg/g", "mg l", "mmol/l"]
HEAVY_METAL = [
    "heavy metal", "metal ion", "pb(ii)", "cd(ii)", "cu(ii)", "zn(ii)", "ni(ii)", "co(ii)", "cr(vi)", "cr(iii)", "as(iii)", "as(v)", "hg(ii)", "u(vi)",
    "lead", "cadmium", "copper", "zinc", "nickel", "cobalt", "chromium", "arsenic", "mercury", "uranium",
]
OTHER_POLLUTANT = [
    "methylene blue", "rhodamine", "crystal violet", "malachite green", "ciprofloxacin", "tetracycline", "diclofenac", "phenol", "bisphenol", "pesticide",
    "phosphate", "nitrate", "ammonia",
]
COMPOSITE = ["metal-organic framework", "mof", "composite", "nanocomposite", "nanoparticle", "ldh", "graphene", "carbon nanotube", "fe3o4", "magnetite"]
REVIEW = ["review", "mini-review", "perspective", "outlook", "bibliometric", "state-of-the-art"]
CHARACTERIZATION = ["bet", "surface area", "pore volume", "pore size", "aps", "tpv", "ph_pzc", "pzc", "elemental composition", "c/o", "o/c", "h/c"]
ADSORPTION_CONDITION = ["c0", "initial concentration", "solution ph", "temperature", "contact time", "dosage", "slr"]
ADSORPTION_PERFORMANCE = ["qe", "qmax", "langmuir", "freundlich", "pseudo-second-order", "pseudo first order", "kinetics"]

_REAGENT = "hcl|h2so4|hno3|h3po4|hydrochloric acid|sulfuric acid|nitric acid|phosphoric acid|citric acid|oxalic acid|acetic acid"
_CHANGE = "treat|activat|modif|wash|impregnat|functional|oxid"
ACID_CONTEXT = [
    ("acid_mod_phrase", r"\bacid[- ]?(?:modified|treated|activation|activated|treatment|functionalized|functionalised)\b"),
    ("reagent_near_modify", rf"(?:{_REAGENT})[^.]{{0,100}}(?:{_CHANGE})"),
    ("modify_near_reagent", rf"(?:{_CHANGE})[^.]{{0,100}}(?:{_REAGENT})"),
    ("biochar_near_reagent", rf"(?:biochar)[^.]{{0,120}}(?:{_REAGENT})|(?:{_REAGENT})[^.]{{0,120}}(?:biochar)"),
]
REAGENT = rf"\b(?:{_REAGENT})\b"
BIOCHAR = r"\bbiochar\b"
PREPARATION_VERB = r"\b(?:pyroly[sz]\w*|carboni[sz]\w*|activat\w*|modif\w*|treat\w*|impregnat\w*|functional\w*|oxid\w*|wash\w*)\b"
PREPARATION_CUE = (
    r"\b(?:prepar\w*|synthesi[sz]\w*|produc\w*|obtain\w*|fabricat\w*|impregnat\w*|soak\w*|treated?\s+with|activation\s+was\s+carried\s+out|"
    r"chemical activation|acid treatment)\b"
)
PH_ADJUSTMENT = r"\b(?:pH\s*(?:was|were)?\s*(?:adjusted|adjustment)|adjust(?:ed)?\s*pH|using\s+(?:naoh|hcl)\s*(?:and|/)\s*(?:naoh|hcl))\b"
NO_MODIFICATION = r"\b(?:desorb\w*|desorption|regenerat\w*|elut\w*|titrat\w*|adsorbed|adsorption isotherm|isotherm|kinetic|equilibrium)\b"
CONCENTRATION = r"\b\d+(?:\.\d+)?\s*(?:m|mol/?l|mmol/?l|%|wt%|v/v|w/v)\b"
DURATION = r"\b\d+(?:\.\d+)?\s*(?:h|hr|hrs|hour|hours|min|mins|minute|minutes)\b"
TEMPERATURE = r"\b\d+(?:\.\d+)?\s*(?:°\s*c|º\s*c|degrees?\s*c|celsius)\b"
UNIT = r"\b(mg/g|g/l|mg/l|mmol/l|mmol/g|m2/g|cm3/g|nm|k|°c|ph|wt%|%)\b"
TABLE = r"\btable\s*\d+\b"
RADIONUCLIDE_CONTEXT = (
    r"\b(?:adsorpt\w*|sorpt\w*|biosorpt\w*|remov\w*|uptake|captur\w*|extract\w*|recover\w*|decontaminat\w*|separat\w*|immobili[sz]\w*|"
    r"retention|eliminat\w*|bind(?:ing)?|wastewater|aqueous\s+solution|contaminat\w*|pollut\w*|ion(?:s)?)\b"
)
RADIONUCLIDE = [
    ("U(VI)", r"(?<![a-z0-9])u\s*\(\s*(?:vi|ⅵ|6)\s*\)"), ("uranium", r"\buranium\b"), ("Cs(I)", r"(?<![a-z0-9])cs\s*\(\s*(?:i|ⅰ|1)\s*\)"),
    ("cesium", r"\b(?:cesium|caesium)\b"), ("Sr(II)", r"(?<![a-z0-9])sr\s*\(\s*(?:ii|ⅱ|2)\s*\)"), ("strontium", r"\bstrontium\b"),
    ("Co(II)", r"(?<![a-z0-9])co\s*\(\s*(?:ii|ⅱ|2)\s*\)"), ("cobalt", r"\bcobalt\b"), ("I-/I⁻", r"(?<![a-z0-9])i\s*(?:-|−|–|—|⁻)(?![a-z0-9])"),
    ("iodide", r"\biodide\b"), ("IO3-/IO₃⁻", r"(?<![a-z0-9])io\s*(?:3|₃)\s*(?:-|−|–|—|⁻)?(?![a-z0-9])"), ("iodate", r"\biodate\b"),
    ("TcO4-/TcO₄⁻", r"(?<![a-z0-9])tc\s*o\s*(?:4|₄)\s*(?:-|−|–|—|⁻)?(?![a-z0-9])"), ("pertechnetate", r"\bpertechnetate\b"), ("technetium", r"\btechnetium\b"),
    ("Th(IV)", r"(?<![a-z0-9])th\s*\(\s*(?:iv|ⅳ|4)\s*\)"), ("thorium", r"\bthorium\b"), ("Eu(III)", r"(?<![a-z0-9])eu\s*\(\s*(?:iii|ⅲ|3)\s*\)"),
    ("europium", r"\beuropium\b"), ("La(III)", r"(?<![a-z0-9])la\s*\(\s*(?:iii|ⅲ|3)\s*\)"), ("lanthanum", r"\blanthanum\b"),
    ("Ce(III)", r"(?<![a-z0-9])ce\s*\(\s*(?:iii|ⅲ|3)\s*\)"), ("cerium", r"\bcerium\b"), ("ReO4-/ReO₄⁻", r"(?<![a-z0-9])re\s*o\s*(?:4|₄)\s*(?:-|−|–|—|⁻)?(?![a-z0-9])"),
    ("perrhenate", r"\bperrhenate\b"), ("rhenium", r"\brhenium\b"),
]

ACID_WORDS = ["acid", "hcl", "hno3", "h2so4", "h3po4", "hydrochloric", "nitric", "sulfuric", "sulphuric", "phosphoric", "citric", "oxalic", "acetic", "formic", "tartaric", "maleic", "lactic"]
NON_ACID_WORDS = ["naoh", "koh", "alkali", "alkaline", "base-modified", "kmno4", "permanganate", "ferric", "fecl3", "metal-loaded", "loaded", "doped", "doping", "magnetic", "nzvi", "composite", "biochar/"]
SOFT_AFTER_WORDS = ["na2co3", "neutralization", "neutralisation", "base wash"]
EXCLUDED_WORDS = ["amin", "amine", "aminated", "amination", "pei", "edta"]
PRISTINE_WORDS = ["pristine", "raw biochar", "raw bc", "unmodified", "original biochar", "pristine biochar"]
PRISTINE_IDS = ["bc", "biochar", "rawbc", "rawbiochar", "pristinebc", "ubc"]
DROPPED_IDS = ["scrhsmt", "scrhwmt", "apbc"]
PARAMETER_IDS = ["qmax", "kl", "kf", "ks", "krp", "qmfs", "kfs", "nfs", "r2"]
PARAMETER_NAMES = ["q max", "k l", "r 2", "k f", "k rp", "α rp", "a rp", "k s", "β s", "b s", "a s", "b t", "n t", "q mfs", "k fs", "n fs", "n"]
CHANGED_WORDS = ["modified", "activation", "activated", "treated", "functionalized"]
REAGENT_IDS = [
    "sulfuric acid", "sulphuric acid", "hydrochloric acid", "nitric acid", "phosphoric acid", "acetic anhydride", "carbon disulfide", "carbon disulphide",
    "elemental sulfur", "elemental sulphur", "iron nitrate", "ammonium tetrathiomolybdate", "mercaptoethanol", "beta-mercaptoethanol",
]
