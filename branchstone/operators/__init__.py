"""branchstone.operators"""
