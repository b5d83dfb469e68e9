"""Incremental work: resume lists that skip what an earlier run finished."""
