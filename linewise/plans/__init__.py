"""linewise.plans"""
