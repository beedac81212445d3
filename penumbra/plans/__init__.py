"""Plan builders: reusable shapes of distributed plans (range blocks, running sums)."""
