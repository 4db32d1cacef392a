"""weftgraph.operators"""
