"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from siltstone.llm.alignment import op13_galloping_alignment
from siltstone.llm.ctw import op8_context_trees
from siltstone.llm.language import op6_nearest_centroid
from siltstone.llm.licenses import op12_diagonal_licenses
from siltstone.llm.lines import op1_segment_lines
from siltstone.llm.minhash import op5_bayes_minhash
from siltstone.llm.mixing import OP9_SQL, op9_capped_mix
from siltstone.llm.packing import op3_best_two_fit
from siltstone.llm.pivots import op2_pivot_permutations
from siltstone.llm.quality import op4_histogram_divergence
from siltstone.llm.recount import op10_edit_counts
from siltstone.llm.sharding import op7_byte_shards
from siltstone.llm.variants import op11_sliced_variants

QUERIES = {
    f.__name__: f
    for f in (
        op1_segment_lines, op2_pivot_permutations, op3_best_two_fit, op4_histogram_divergence, op5_bayes_minhash,
        op6_nearest_centroid, op7_byte_shards, op8_context_trees, op9_capped_mix, op10_edit_counts,
        op11_sliced_variants, op12_diagonal_licenses, op13_galloping_alignment)
}

ORACLES = {"op9_capped_mix": OP9_SQL}
