"""Explicit schemas of every input; nothing is inferred."""

VECTORS = "char string, codePoint string, tr39 string, nfkc string"
PAIRS = "source string, sourceCodepoint string, target string"
CANDIDATES = "codepoint string, char string, name string, generalCategory string, script string, fontCoverage int"
SEQUENCES = "sequence string, chars array<string>, length int"
FONT_RESULT = "struct<sourceFont: string, targetFont: string, ssim: double, pHash: double, sourceRenderStatus: string, sourceFallbackFont: string, ssimSkipped: boolean>"
SUMMARY = "struct<meanSsim: double, meanPHash: double, nativeFontCount: int, fallbackFontCount: int, notdefFontCount: int, validFontCount: int>"
DISCOVERY = f"source string, sourceCodepoint string, sourceChars array<string>, target string, fonts array<{FONT_RESULT}>, summary {SUMMARY}"
CROSS_SCRIPT = f"charA string, codepointA string, scriptA string, charB string, codepointB string, scriptB string, summary {SUMMARY}, bestFont struct<sourceFont: string, targetFont: string, ssim: double, pHash: double>, fonts array<{FONT_RESULT}>"
RENDER = "struct<font: string, category: string, pHash: string, renderStatus: string, fallbackFont: string, png: string, inkWidth: int, inkHeight: int>"
RENDER_INDEX = f"meta map<string, string>, sources map<string, array<{RENDER}>>, targets map<string, array<{RENDER}>>"
SCRIPT_SETS = "meta map<string, string>, scripts map<string, struct<description: string, characterCount: int, characters: array<struct<codepoint: string, char: string, name: string, generalCategory: string, fontCoverage: int>>>>"
GLYPH_REUSE = "source string, sourceCodepoint string, target string, checkedCount int, glyphReuseCount int, rasterCoincidenceCount int, glyphReuse boolean, fonts array<struct<font: string, fontPath: string, sourceGlyphId: int, targetGlyphId: int, glyphReuse: boolean>>"
ATTACK_RUN = "model string, provider string, variant string, run int, temperature double, timestamp string, latencyMs bigint, usage map<string, bigint>, stop_reason string, responseLength int, content string, error string"
CLAUSES = ("c1_grant", "c2_fees", "c3_liability", "c4_indemnification", "c5_termination", "c6_auto_renewal", "c7_data_rights", "c8_governing_law")
TRAPS = ("t1_revocable", "t2_non_refundable", "t3_liability_cap", "t4_one_sided_indemnification", "t5_without_cause", "t6_auto_renewal", "t7_perpetual_data_rights", "t8_jury_waiver_jurisdiction")
ATTACK_SCORE = (
    "model string, variant string, run int, timestamp string, scoredAt string, "
    f"clauseRecall struct<{', '.join(f'{c}: boolean' for c in CLAUSES)}>, trapDetection struct<{', '.join(f'{t}: boolean' for t in TRAPS)}>, "
    "riskClausesIdentified int, silentOmissions array<string>, detectedAnomalies boolean, responseLength int, notes string"
)
