"""Fixed values of the data model."""

#: Residues by their 5-bit code 0..27 (fixed value; the order of packed keys follows it).
AA28 = "ARNDCQEGHILKMFPSTWYVOUBJZX*-"
#: Amino acids of the 64 codons of the standard genetic code (fixed value), index 16*b1 + 4*b2 + b3 with A0 C1 G2 T3.
CODON64 = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
#: The same of the vertebrate mitochondrial code (fixed value).
MITOCHONDRIAL64 = "KNKNTTTT*S*SMIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSSWCWCLFLF"
BITS_PER_RESIDUE = 5
#: Longest k-mer whose packed key is a non-negative BIGINT.
MAX_RESIDUES = 12
#: Mask of a k-mer that no annotated transcript holds; bit 0 is this name in every table.
INTERGENIC_MASK = 1
INTERGENIC = "intergenic"
MAX_BIOTYPES = 64
#: Residues dropped from a key to give its index prefix.
SUFFIX_RESIDUES = 4
FORMAT_VERSION = 3.0
COUNTS_LAYER, BIOTYPE_LAYER = 1, 2
