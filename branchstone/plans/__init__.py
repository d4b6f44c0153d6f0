"""branchstone.plans"""
